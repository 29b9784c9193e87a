import numpy as np
import pytest

from isoframe.functions import hevc, metadata
from isoframe.operators import images
from isoframe.operators import sequences as seq
from isoframe.plans import container as ct
from isoframe.plans import samples
from isoframe.sources import boxes, heif
from isoframe.sources import writer as w


@pytest.fixture(scope="module")
def c(spark, tmp_path_factory):
    return samples.containers(spark).write(str(tmp_path_factory.mktemp("parsed") / "p"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bad_files_are_rows(c):
    assert {r.path for r in c.errors.collect()} == {"broken.heif", "empty.heif"}
    assert c.items.where("path = 'single.heif'").count() == 5


def test_top_level(c):
    top = rows(ct.top_level_images(c), "path", "item_id")
    assert top == [("grid.heif", 5), ("overlay.heif", 3), ("overlay.heif", 4), ("regions.heif", 1), ("sequence.heif", 1), ("single.heif", 1)]


def test_lookups(c):
    assert rows(ct.thumbnails(c), "path", "item_id", "thumb_id") == [("single.heif", 1, 3)]
    assert ("grid.heif", 5, 7, 14, 11) in rows(ct.auxiliary_images(c), "path", "item_id", "aux_id", "width", "height")
    xmp = rows(ct.xmp_items(c), "path", "item_id", "source_id")
    assert ("single.heif", 1, 5) in xmp and ("grid.heif", 5, 6) in xmp  # the grid has that of its first tile
    icc = {(r.path, r.item_id): bytes(r.icc) for r in ct.icc_profiles(c).collect()}
    assert icc[("grid.heif", 5)] == b"profile"
    assert ("grid.heif", 5, 8) in rows(ct.bit_depths(c), "path", "item_id", "bit_depth")
    assert ("single.heif", 1, 1, 13) in rows(ct.colours(c), "path", "item_id", "primaries", "transfer")
    assert rows(ct.region_items(c), "path", "item_id", "source_id") == [("regions.heif", 1, 2)]
    roots = c.files.where("path = 'grid.heif'").selectExpr("path", "primary_id item_id")
    assert rows(ct.wanted_items(c, roots), "item_id") == [(k,) for k in range(1, 8)]


def test_wanted_items_of_long_chains_and_circles(spark):
    f = w.Writer("mif1")
    n = f.add_image("unci", samples.planar(samples.rgb(4, 4)), 4, 4, *samples.UNCOMPRESSED)
    for _ in range(20):
        n = f.add_identity(n, 4, 4)
    f.reference("dimg", 1, [n])
    f.set_primary(n)
    content = f.finish()
    c = heif.Containers(heif.parse(spark.createDataFrame([("chain", len(content), bytearray(content))], samples.FILES)))
    roots = c.files.selectExpr("path", "primary_id item_id")
    assert rows(ct.wanted_items(c, roots), "item_id") == [(k,) for k in range(1, 22)]


def test_item_data(c):
    data = {(r.path, r.item_id): bytes(r.data) for r in ct.item_data(c).collect() if r.data is not None}
    assert data[("single.heif", 5)] == b"<x/>"
    found = metadata.exif(data[("single.heif", 4)])
    assert (found["make"], found["orientation"], found["model"], found["has_gps"]) == ("Apple", 6, None, False)
    region = metadata.regions(data[("regions.heif", 2)], [])
    assert (region["width"], region["regions"][0]["x"], region["regions"][0]["y"]) == (4032, 10, -5)


@pytest.mark.parametrize("per_chunk", [None, 1, 2, 4])
def test_sequences(spark, per_chunk):
    content = samples.sequence(per_chunk)
    files = spark.createDataFrame([("s", len(content), bytearray(content))], samples.FILES)
    t = heif.Containers(heif.parse(files)).tracks
    got = seq.samples(t).orderBy("n").collect()
    assert [r.size for r in got] == [1, 2, 3, 4, 5, 6] and [r.sync for r in got] == [True, False, False, False, True, False]
    assert [content[r.offset : r.offset + r.size] for r in got] == [bytes([k]) * (k + 1) for k in range(6)]
    shown = seq.frames(t).orderBy("frame_no").collect()
    assert [r.n for r in shown] == [0, 2, 3, 1, 4, 5]
    assert [round(r.duration * 25) for r in shown] == [1, 1, 1, 0, 2, 1]
    assert seq.track_durations(t).first().seconds == 6 / 25 and seq.main_tracks(t).count() == 1


def test_decoding():
    out = images.Decoder(samples.single()).decode()
    assert (out.data[..., :3] == samples.rgb(12, 8)).all() and not out.has_alpha
    g = images.Decoder(samples.grid()).decode()
    whole = np.concatenate([np.concatenate([samples.rgb(8, 6, 2 * r + k) for k in range(2)], 1) for r in range(2)], 0)[:11, :14]
    assert (g.data[..., :3] == whole).all() and g.data[..., 3].ravel().tolist() == list(range(154))
    o = images.Decoder(samples.overlay()).decode(3)
    assert o.data[0, 0].tolist() == [255, 0, 0, 255] and (o.data[1:6, 1:6, :3][:4] == samples.rgb(5, 5, 7)[:4]).all()
    t = images.Decoder(samples.overlay()).decode()
    turned = np.rot90(samples.rgb(5, 5, 7))[:, ::-1]
    assert (t.data[..., :3] == turned[1:5, 1:4]).all() or t.data.shape == (4, 3, 4)


def unci(config, data, width, height, types=None):
    f = w.Writer("mif1")
    extra = (w.component_types(*types),) if types else ()
    f.add_image("unci", data, width, height, *extra, config)
    return images.Decoder(f.finish()).decode()


def test_uncompressed_layouts():
    planes = bytes([255, 0, 0, 255, 0, 255, 255, 0, 0, 0, 128, 255])
    out = unci(w.uncompressed([(8, 0)] * 3), planes, 2, 2)
    assert out.data[..., :3].reshape(-1, 3).tolist() == [[255, 0, 0], [0, 255, 0], [0, 255, 128], [255, 0, 255]]
    rgba = bytes([255, 0, 0, 255, 0, 255, 0, 128, 0, 0, 255, 64, 10, 20, 30, 40])
    out = unci(w.uncompressed([(8, 0)] * 4, interleave=1), rgba, 2, 2)
    assert out.has_alpha and out.data.reshape(-1, 4).tolist() == [list(rgba[k : k + 4]) for k in range(0, 16, 4)]
    out = unci(w.uncompressed([(8, 0)], row_align=4), bytes([1, 2, 3, 9, 4, 5, 6, 9]), 3, 2)
    assert out.data[..., 0].tolist() == [[1, 2, 3], [4, 5, 6]]
    out = unci(w.uncompressed([(8, 0)], columns=2, rows=2), bytes([1, 2, 3, 4]), 2, 2)
    assert out.data[..., 0].tolist() == [[1, 2], [3, 4]]
    out = unci(w.uncompressed([(16, 2)], flags=128), bytes([1, 2, 255, 255]), 2, 1)
    assert out.depth == 16 and out.data[..., 0].tolist() == [[0x0201, 0xFFFF]]
    out = unci(w.uncompressed([(7, 0)]), bytes([0b11111110, 0b00000100]), 2, 1)
    assert out.data[..., 0].tolist() == [[255, images.rescale(np.array(1), 127, 255)]]
    with pytest.raises(boxes.BadFile):
        unci(w.uncompressed([(8, 0)], block_size=2), bytes(4), 2, 2)


def test_geometry_and_blending():
    numbered = images.Image(np.arange(6).reshape(2, 3, 1).repeat(4, 2))
    flat = lambda i: i.data[..., 0].ravel().tolist()
    assert [flat(images.rotate(numbered, k)) for k in (1, 2, 3)] == [[2, 5, 1, 4, 0, 3], [5, 4, 3, 2, 1, 0], [3, 0, 4, 1, 5, 2]]
    assert flat(images.mirror(numbered, False)) == [2, 1, 0, 5, 4, 3] and flat(images.mirror(numbered, True)) == [3, 4, 5, 0, 1, 2]
    assert flat(images.crop(numbered, 1, 1, 5, 5)) == [4, 5]
    black, white = images.filled(1, 1, 8, [0, 0, 0, 255]), images.Image(np.array([[[255, 255, 255, 128]]]), 8, True)
    assert images.draw(black, white, 0, 0).data[0, 0, 0] == 128
    assert np.allclose(images.gain_at(np.array([[0.0, 1.0]]), 4, 1), [[0, 0.25, 0.75, 1]])


def test_colour_columns(spark):
    from pyspark.sql import functions as F

    from isoframe.functions import colour

    r = spark.range(1).select(
        colour.pq_to_linear(F.lit(0.58)).alias("a"), colour.pq_to_linear(F.lit(1.0)).alias("b"), colour.hlg_to_linear(*[F.lit(0.75)] * 3)[0].alias("c"),
        colour.hlg_to_linear(*[F.lit(1.0)] * 3)[0].alias("d"), colour.parse_size(F.lit("1.5M")).alias("e"), colour.parse_size(F.lit("x")).alias("f"),
        colour.human_bytes(F.lit(1_234_567)).alias("g"), colour.parse_format(F.lit("YUV420")).alias("h"), colour.frame_name(F.lit(7), F.lit(12345)).alias("i"),
    ).first()
    assert abs(r.a - 1) < 0.01 and abs(r.b - 49.261) < 0.001 and abs(r.c - 1) < 0.03 and abs(r.d - 4.926) < 0.001
    assert (r.e, r.f, r.g, r.h, r.i) == (1_500_000, None, "1.2 MB", "420", "00007")


def test_metadata_blocks():
    utf8 = b"\x1c\x01\x5a\x00\x03\x1b%G"
    data = utf8 + b"".join(b"\x1c" + bytes(k) + len(v).to_bytes(2, "big") + v for k, v in (((2, 120), "Grüße ".encode()), ((2, 25), b"a"), ((2, 25), b"b")))
    view = metadata.iptc_view(data)
    assert view["caption"] == "Grüße" and view["keywords"] == ["a", "b"] and view["city"] is None
    block = b"8BIM\x04\x04\x00\x00" + len(data).to_bytes(4, "big") + data
    assert metadata.iptc(block) == metadata.iptc(data)
    spec = [
        {"kind": "rectangle", "x": 100, "y": 200, "width": 300, "height": 400, "points": None, "bits": None},
        {"kind": "polygon", "x": None, "y": None, "width": None, "height": None, "points": [(1, 2), (3, 4), (5, 70_000)], "bits": None},
        {"kind": "inline_mask", "x": 3, "y": 4, "width": 3, "height": 3, "points": None, "bits": b"\xaa\x80"},
    ]
    got = metadata.regions(metadata.write_regions(4032, 3024, spec), [])
    assert [{k: r[k] for k in s} for r, s in zip(got["regions"], spec, strict=True)] == spec
    assert metadata.mask_bit(b"\xaa\x80", 3, 3, 0, 0) and metadata.mask_bit(b"\xaa\x80", 3, 3, 2, 2) and not metadata.mask_bit(b"\xaa\x80", 3, 3, 1, 0)
    t = samples.tiff({0x0112: 6, 0x0110: b"Model X\0"})
    assert metadata.exif(bytes(4) + metadata.upright(t))["orientation"] == 1 and metadata.Tiff(t).text(0x0110) == "Model X"
    assert abs(metadata.apple_headroom(0.5, 0.0) - 2**1.8) < 1e-6


def test_hevc_fields():
    assert hevc.unescape(b"\0\0\3\1") == b"\0\0\1"
    assert hevc.split_annex_b(b"\0\0\0\1\x40\x01\0\0\1\x42\x01\x05") == [b"\x40\x01", b"\x42\x01\x05"]
    assert hevc.nal_header(b"\x42\x01") == {"type": 33, "layer": 0, "temporal_id": 0}
    r = hevc.Bits(bytes([0b10100110, 0b01000010, 0b10000000]))
    assert [r.ue() for _ in range(4)] == [0, 1, 2, 3]
    plane = np.arange(12).reshape(3, 4)
    assert hevc.plane_md5(plane, 8).hex() == __import__("hashlib").md5(bytes(range(12))).hexdigest()
    assert hevc.plane_checksum(np.zeros((1, 4), int), 8) == 0 ^ 0 + 1 + 2 + 3
    m = hevc.core_matrix(4)
    assert m.tolist() == [[64, 64, 64, 64], [83, 36, -36, -83], [64, -64, -64, 64], [36, -83, 83, -36]]
    for n in (4, 8, 16, 32):
        big = hevc.core_matrix(n)
        assert np.abs(big @ big.T - np.eye(n) * 4096 * n).max() < 600
        x = np.random.default_rng(n).integers(-255, 256, (n, n))
        assert np.abs(hevc.inverse_transform(hevc.forward_transform(x, 8), 8) - x).max() <= 8
    assert hevc.order_count(1, 4, False, 15) == 17 and hevc.order_count(15, 4, False, 16) == 15


def test_writer_shares_properties_and_rejects_broken_boxes():
    f = w.Writer()
    assert f.property(w.ispe(1, 2)) == f.property(w.ispe(1, 2)) == 1
    assert boxes.file_type(b"\0\0\0\x18ftypheic") == "Supported" and boxes.file_type(b"\0\0\0\x18ftypavif") == "Unsupported"
    assert boxes.file_type(b"\0\0") == "MayBe" and boxes.file_type(b"not a heif file") == "No"
    with pytest.raises(boxes.BadFile):
        list(boxes.children(b"\0\0\0\x40free"))


def test_streams(spark, tmp_path):
    from isoframe.streaming import frames

    for name, make in samples.ALL.items():
        (tmp_path / name).write_bytes(make())
    parsed = heif.Containers(heif.parse(frames.new_files(spark, str(tmp_path), "*.heif")))
    q = parsed.items.writeStream.format("memory").queryName("items_seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("items_seen").count() == heif.read(spark, str(tmp_path)).items.count() > 10


def test_bumping():
    from isoframe.streaming.frames import step

    waiting, out = [], []
    for n, poc in enumerate([0, 4, 2, 1, 3, 8, 6]):
        out += step(waiting, poc, n, False, 2, None)
    assert [p for _, p in out] == [0, 1, 2, 3, 4] and sorted(p for p, _, _ in waiting) == [6, 8]
    assert step(waiting, 0, 7, True, 2, None) == [(6, 6), (5, 8)]


def test_depth_information_in_groups_of_units():
    from isoframe.functions import hdr

    def sized(x):
        return len(x).to_bytes(4, "big") + x

    # z_near alone: flags 1000, kind ue(1) = 010, then sign 0, exponent 31, a mantissa of 1 bit (length - 1 in 5 bits).
    bits = "1000" + "010" + "0" + f"{31:07b}" + "00000" + "1"
    payload = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    unit = bytes((39 << 1, 1, 5, 1, 0)) + bytes((177, len(payload))) + payload + b"\x80"  # behind another message
    want = {"kind": 1, "z_near": 1.5, "z_far": None, "d_min": None, "d_max": None, "reference_view": None, "nonlinear": None}
    assert hdr.depth_info(sized(sized(unit))) == want
    assert hdr.depth_info(sized(sized(b"\x40\1ab") + sized(unit))) == want
    assert hdr.depth_info(sized(sized(bytes((1 << 1,)) + unit[1:]))) is None
    assert hdr.depth_info(sized(sized(unit))[:-1]) is None
