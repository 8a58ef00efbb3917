"""Layout files, TIFF directories, image folders and the catalogue."""

import json
import struct
import zlib

import pytest

from gridloom.sources import catalog, images, oasis


def head():
    return oasis.MAGIC + bytes([oasis.START]) + oasis.text("1.0") + b"\0" + oasis.unsigned(1000) + b"\0" + bytes(12)


def test_numbers():
    c = oasis.Cursor(b"".join(map(oasis.unsigned, (0, 127, 128, 2**40))) + b"".join(map(oasis.signed, (0, -1, 5, -(2**33)))))
    assert [c.uint() for _ in range(4)] == [0, 127, 128, 2**40] and [c.sint() for _ in range(4)] == [0, -1, 5, -(2**33)]
    assert oasis.Cursor(b"\x03\x04").real() == -0.25 and oasis.Cursor(b"\x04\x03\x02").real() == 1.5
    assert oasis.Cursor(bytes([7]) + struct.pack("<d", 2.5)).real() == 2.5


def test_rectangles_modal_square_relative_and_packed():
    u, s = oasis.unsigned, oasis.signed
    body = bytes([oasis.CELL_NAME]) + oasis.text("C")
    body += bytes([oasis.RECTANGLE, 0b01111011]) + u(7) + u(1) + u(30) + u(20) + s(-5) + s(6)
    body += bytes([oasis.RELATIVE, oasis.RECTANGLE, 0b00010000]) + s(100)
    body += bytes([oasis.RECTANGLE, 0b11000100]) + u(8) + u(1) + u(1) + u(0) + u(50) + u(60)
    packed = zlib.compress(body)[2:-4]
    raw = head() + bytes([oasis.CBLOCK, 0]) + u(len(body)) + u(len(packed)) + packed + bytes([oasis.END])
    rows = list(oasis.decode(raw))
    box = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"])
    assert [box(r) for r in rows] == [(-5, 6, 25, 26), (95, 6, 125, 26), (95, 6, 103, 14)]
    assert (rows[2]["nx"], rows[2]["ny"], rows[2]["vx"], rows[2]["wy"]) == (3, 2, 50, 60)


def test_placements_and_errors():
    u, s = oasis.unsigned, oasis.signed
    raw = head() + bytes([oasis.CELL_NUMBER]) + u(0) + bytes([oasis.PLACEMENT, 0b11110101]) + u(3) + s(10) + s(-20) + bytes([oasis.END])
    (row,) = oasis.decode(raw)
    assert (row["child"], row["x1"], row["y1"], row["q"], row["flip"]) == ("3", 10, -20, 2, True)
    for bad in (b"", b"nonsense" * 9, head() + b"\x63", raw[:-4]):
        assert list(oasis.decode(bad))[-1]["kind"] == "error"


def tiff(big, order, n):
    pack = lambda f, *v: struct.pack(order + f, *v)
    out = (b"II" if order == "<" else b"MM") + (pack("HHHQ", 43, 8, 0, 16) if big else pack("HI", 42, 8))
    for k in range(n):
        tags = [(256, 4, 100 + k), (257, 3, 50), (258, 3, 8), (259, 3, 1)]
        size = (8 + 20 * len(tags) + 8) if big else (2 + 12 * len(tags) + 4)
        following = len(out) + size if k < n - 1 else 0
        out += pack("Q" if big else "H", len(tags))
        for tag, kind, value in tags:
            body = pack("I" if kind == 4 else "H", value).ljust(8 if big else 4, b"\0")
            out += pack("HH", tag, kind) + pack("Q" if big else "I", 1) + body
        out += pack("Q" if big else "I", following)
    return out


def test_tiff_pages(spark):
    files = [(f"{big}{order}", tiff(big, order, 3)) for big in (False, True) for order in "<>"] + [("bad", b"xx"), ("empty", None)]
    rows = images.tiff_pages(spark.createDataFrame(files, "path string, content binary")).collect()
    assert sorted((r.page, r.width, r.height, r.bits) for r in rows if r.message is None) == sorted((k, 100 + k, 50, 8) for k in range(3) for _ in range(4))
    assert {r.path for r in rows if r.message} == {"bad", "empty"}
    looped = bytearray(tiff(False, "<", 2))
    looped[-4:] = struct.pack("<I", 8)
    with pytest.raises(ValueError):
        list(images.pages(bytes(looped)))


def test_folder(spark, tmp_path):
    for name in ("a.tif", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    assert sorted(r.image_id for r in images.folder(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_catalog(spark, tmp_path):
    good = {"schema": "s1", "parts": {"P": {"description": "d", "chips": {"C1": {"chip_x_um": 1.5, "other": 2}, "C2": {}}}}}
    (tmp_path / "g.json").write_text(json.dumps(good))
    rows = {r.chip_id: r.chip_x_um for r in catalog.load(spark, str(tmp_path / "g.json"), "s1").collect()}
    assert rows == {"C1": 1.5, "C2": None}
    with pytest.raises(ValueError):
        catalog.load(spark, str(tmp_path / "g.json"), "s2")
