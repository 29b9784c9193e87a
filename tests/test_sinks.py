import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.functions import hdr, icc
from isoframe.operators import images
from isoframe.plans import samples
from isoframe.sources import datasource, heif, sinks


def read_png(data):
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + n)[0]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, depth, kind = head[:4]
    channels = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, -1)[:, 1:]
    return rows.copy().view(">u2" if depth == 16 else "u1").reshape(h, w, channels)


def test_png():
    x = samples.rgb(5, 3)
    assert (read_png(sinks.png(x)) == x).all()
    assert (read_png(sinks.png(np.full((2, 2, 4), 1023), 10)) == 65535).all()
    assert b"acTL" in sinks.apng([x, x], [0.1, 100.0]) and sinks.delay(100.0) == 65535


def test_written_files_decode_again(spark, tmp_path):
    decoded = images.decoded(heif.parse(samples.files(spark, ("single.heif", "grid.heif", "broken.heif"))))
    out = sinks.write_images(decoded, f"file://{tmp_path}/o", "heif", F.regexp_replace("path", "\\..*", "")).collect()
    assert sorted(r.file.split("/")[-1] for r in out) == ["grid.heif", "single.heif"]
    again = images.Decoder((tmp_path / "o" / "single.heif").read_bytes()).decode()
    assert (again.data[..., :3] == samples.rgb(12, 8)).all()
    assert images.Decoder((tmp_path / "o" / "grid.heif").read_bytes()).decode().has_alpha
    with pytest.raises(ValueError):
        sinks.write_images(decoded, "file:///x", "tga", F.col("path"))


def test_data_source(spark, tmp_path):
    for name, make in samples.ALL.items():
        (tmp_path / name).write_bytes(make())
    datasource.register(spark)
    got = spark.read.format("heif").load(f"file://{tmp_path}").collect()
    whole = heif.Containers(heif.parse(samples.files(spark))).items
    assert sum(r.error is None for r in got) == whole.count()
    assert {r.path.split("/")[-1] for r in got if r.error} == {"broken.heif", "empty.heif"}


def test_fit_to_size():
    encode = lambda q: bytes(10 * q)
    assert sinks.fit_to_size(255, encode, range(0, 101, 5))[1] == 25
    assert sinks.fit_to_size(-1, encode, range(5)) is None


def test_profiles():
    assert np.allclose(icc.primaries_matrix(1), np.eye(3), atol=1e-9)
    assert np.allclose(icc.primaries_matrix(9).sum(1), 1) and icc.primaries_matrix(22) is None
    data = np.random.default_rng(0).integers(0, 256, (4, 4, 4)).astype(np.uint16)
    assert (icc.from_primaries(data, 8, 1, 13) == data).all()
    grey = np.full((1, 1, 4), 128, np.uint16)
    assert (icc.from_primaries(grey, 8, 12, 13)[..., :3] == 128).all()
    d50 = np.linalg.inv(icc.adaptation(np.array(icc.D50), icc.xyz(icc.D65)))
    m = d50 @ icc.to_xyz(1)
    tags = [(b"rXYZ", 0), (b"gXYZ", 1), (b"bXYZ", 2)]
    curve = b"para" + bytes(4) + struct.pack(">HH5i", 3, 0, *(round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
    blobs = [b"XYZ " + bytes(4) + struct.pack(">3i", *(round(v * 65536) for v in m[:, k])) for _, k in tags] + [curve] * 3
    names, at, table, body = [t for t, _ in tags] + [b"rTRC", b"gTRC", b"bTRC"], 132 + 12 * 6, b"", b""
    for n, b in zip(names, blobs, strict=True):
        table += struct.pack(">4sII", n, at + len(body), len(b))
        body += b
    head = bytes(16) + b"RGB " + bytes(108) + struct.pack(">I", 6)
    matrix, curves = icc.profile(head + table + body)
    assert np.allclose(matrix, np.eye(3), atol=1e-3)
    assert np.abs(icc.convert(data, 8, matrix, lambda k, x: curves[k](x)).astype(int) - data).max() <= 1
    assert icc.profile(b"") is None


def test_gain_metadata():
    meta = hdr.parse_gain_metadata(hdr.gain_payload(8.0))
    assert len(hdr.gain_payload(8.0)) == 62 and meta.alternate_headroom == 3 and hdr.weight(meta, 8.0) == 1 and hdr.weight(meta, 1.0) == 0
    out = hdr.apply_gain_metadata(np.full((1, 1, 3), 0.5), np.ones((1, 1, 1)), meta, 8.0)
    assert np.allclose(out, 4.0)
    with pytest.raises(ValueError):
        hdr.parse_gain_metadata(b"\0\0\1\0\0\0")
