import numpy as np
import pytest

from isoframe.functions import hevc


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, n, v):
        self.bits += format(v, f"0{n}b") if n else ""
        return self

    def ue(self, v):
        x = format(v + 1, "b")
        self.bits += "0" * (len(x) - 1) + x
        return self

    def se(self, v):
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def done(self, head=b""):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return head + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_exp_golomb_round_trip():
    w, values = Writer(), [0, 1, 7, 100, 65535]
    for v in values:
        w.ue(v).se(v).se(-v)
    r = hevc.Bits(w.done())
    assert [(r.ue(), r.se(), r.se()) for _ in values] == [(v, v, -v) for v in values]
    with pytest.raises(ValueError):
        hevc.Bits(bytes(8)).ue()


def test_sequence_parameter_set():
    w = Writer().u(4, 0).u(3, 0).u(1, 1).u(8, 1).u(32, 0).u(48, 0).u(8, 93).ue(0).ue(1).ue(1440).ue(964).u(1, 1)
    for v in (0, 0, 0, 2):
        w.ue(v)
    w.ue(0).ue(0).ue(4).u(1, 1).ue(4).ue(2).ue(0).ue(0).ue(3).ue(0).ue(3)
    s = hevc.sps(w.done(b"\x42\x01"))
    assert s["shown"] == (1440, 960) and s["luma_depth"] == 8 and s["level"] == 93 and s["ctb"] == 64 and s["poc_bits"] == 8


def test_picture_parameter_set_with_tiles():
    w = Writer().ue(0).ue(0).u(7, 0).ue(0).ue(0).se(-2).u(3, 0).se(1).se(-1).u(4, 0).u(1, 1).u(1, 0).ue(1).ue(0).u(1, 0).ue(2).u(1, 1).u(1, 1).u(1, 0)
    p = hevc.pps(w.done(b"\x44\x01"))
    assert p["qp"] == 24 and p["columns"] == [3] and p["tile_counts"] == (2, 1)
    assert hevc.tile_scan(4, 2, [3, 1], [2]) == [0, 1, 2, 4, 5, 6, 3, 7]
    assert hevc.uniform_spacing(3, 10) == [3, 3, 4]


def test_reference_sets():
    first = hevc.short_term_set(hevc.Bits(Writer().ue(2).ue(1).ue(0).u(1, 1).ue(1).u(1, 0).ue(0).u(1, 1).done()), 0, [])
    assert first == [(-1, True), (-3, False), (1, True)]
    predicted = hevc.short_term_set(hevc.Bits(Writer().u(1, 1).u(1, 1).ue(0).u(1, 1).u(1, 1).u(1, 0).u(1, 0).u(1, 1).done()), 1, [first])
    assert predicted == [(-1, True), (-2, True), (-4, True)]
    assert hevc.reference_list([5, 3], [9], [], 4) == [5, 3, 9, 5] and hevc.reference_list([5], [9], [], 2, [1, 0]) == [9, 5]


def test_interpolation_of_a_flat_plane():
    plane = np.full((16, 16), 77)
    for taps, n in ((hevc.LUMA_TAPS, 4), (hevc.CHROMA_TAPS, 8)):
        for fx in range(n):
            for fy in range(n):
                assert (hevc.interpolate(plane, -3, 12, fx, fy, 8, 4, 8, taps) == 77 << 6).all()


def test_partitions_cover_their_block():
    for mode in ("2Nx2N", "2NxN", "Nx2N", "NxN", "2NxnU", "2NxnD", "nLx2N", "nRx2N"):
        seen = np.zeros((16, 16), int)
        for x, y, w, h in hevc.partition(mode, 0, 0, 16):
            seen[y : y + h, x : x + w] += 1
        assert (seen == 1).all()


def test_loop_filters():
    plane = np.array([[10, 10, 10], [10, 5, 10], [10, 10, 10]])
    assert hevc.sao_edge(plane, 0, [3, 1, -1, -3], 8)[1].tolist() == [10, 8, 10]
    assert hevc.sao_band(np.array([[0, 8, 255]]), 0, [1, 2, 3, 4], 8).tolist() == [[1, 10, 255]]
    assert [hevc.boundary_strength(*a) for a in ((True, False, False, True), (False, True, True, True), (False, False, False, True))] == [2, 1, 0]
    assert hevc.cropped(plane, [1, 0, 0, 1]).tolist() == [[10, 10], [5, 10]]


def test_quantisation_round_trip():
    x = np.random.default_rng(0).integers(-200, 200, (8, 8))
    for qp in (4, 10, 22):
        levels = hevc.quantised(hevc.forward_transform(x, 8), qp, 8)
        back = hevc.inverse_transform(hevc.dequantised(levels, qp, 8), 8)
        assert np.abs(back - x).max() <= 2 ** (qp / 6) + 4


def test_motion_and_access_units():
    assert hevc.scaled_motion((8, -8), 4, 2) == (4, -4) and hevc.scaled_motion((8, -8), 2, 4) == (16, -16)
    aud, idr, trail = b"\x46\x01\x50", b"\x26\x01\x80\x11", b"\x02\x01\x80\x22"
    more = b"\x02\x01\x00\x33"
    stream = b"".join(b"\0\0\1" + n for n in (aud, idr, aud, trail, more, trail))
    assert [len(u) for u in hevc.access_units(stream)] == [2, 3, 1]
