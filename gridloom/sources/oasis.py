"""Layout files of the SEMI P39 format: rectangles and placements, both ways.

Files are rows (path, content), as ``binaryFile`` gives them or as the writer
makes them; decoding is one task a file. Covered are the records START, END, PAD,
CELL, XYABSOLUTE, XYRELATIVE, PLACEMENT (17), RECTANGLE, CBLOCK, and repetitions
0 to 3, 8 and 9; any other record is an error row, not a crash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format.
MAGIC = b"%SEMI-OASIS\r\n"
PAD, START, END, CELL_NUMBER, CELL_NAME, ABSOLUTE, RELATIVE, PLACEMENT, RECTANGLE, CBLOCK = 0, 1, 2, 13, 14, 15, 16, 17, 20, 34
END_SIZE = 256


def unsigned(n: int) -> bytes:
    """Seven bits a byte, lowest first; the top bit says more follow."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def signed(n: int) -> bytes:
    """The sign is the lowest bit, the magnitude follows."""
    return unsigned(abs(n) << 1 | (n < 0))


def text(value: str) -> bytes:
    raw = value.encode("ascii", "backslashreplace")
    return unsigned(len(raw)) + raw


def encode(cell: str, rects, unit: int = 1000) -> bytes:
    """A file of one cell with rectangles (layer, datatype, x1, y1, x2, y2)."""
    out = [MAGIC, bytes([START]), text("1.0"), b"\0", unsigned(unit), b"\0", bytes(12), bytes([CELL_NAME]), text(cell)]
    for layer, datatype, x1, y1, x2, y2 in rects:
        out += [bytes([RECTANGLE, 0b01111011]), unsigned(layer), unsigned(datatype), unsigned(x2 - x1), unsigned(y2 - y1), signed(x1), signed(y1)]
    return b"".join([*out, bytes([END]).ljust(END_SIZE, b"\0")])


class Cursor:
    """A place in bytes; blocks that are packed are read through, one in another."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.outer = raw, 0, []

    def more(self) -> bool:
        while self.at >= len(self.raw) and self.outer:
            self.raw, self.at = self.outer.pop()
        return self.at < len(self.raw)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("file ends inside a record")
        self.at += n
        return self.raw[self.at - n : self.at]

    def uint(self) -> int:
        n = shift = 0
        while True:
            (b,) = self.take(1)
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n
            if shift > 70:
                raise ValueError("number is too long")

    def sint(self) -> int:
        n = self.uint()
        return -(n >> 1) if n & 1 else n >> 1

    def string(self) -> str:
        return self.take(self.uint()).decode("ascii", "backslashreplace")

    def real(self) -> float:
        kind = self.uint()
        if kind < 2:
            return (1 - 2 * kind) * float(self.uint())
        if kind < 4:
            return (1 if kind == 2 else -1) / self.uint()
        if kind < 6:
            return (1 if kind == 4 else -1) * self.uint() / self.uint()
        return struct.unpack("<f" if kind == 6 else "<d", self.take(4 if kind == 6 else 8))[0]

    def delta(self) -> tuple[int, int]:
        """A general step: one of eight directions and a length, or two numbers."""
        n = self.uint()
        if n & 1:
            x = n >> 2
            return (-x if n & 2 else x), self.sint()
        x, y = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1))[n >> 1 & 7]
        return x * (n >> 4), y * (n >> 4)

    def repetition(self, last):
        """(nx, ny, (vx, vy), (wx, wy))."""
        kind = self.uint()
        if kind == 0:
            return last
        if kind == 1:
            nx, ny = self.uint() + 2, self.uint() + 2
            return nx, ny, (self.uint(), 0), (0, self.uint())
        if kind in (2, 3):
            n, step = self.uint() + 2, self.uint()
            return (n, 1, (step, 0), (0, 0)) if kind == 2 else (1, n, (0, 0), (0, step))
        if kind == 8:
            nx, ny = self.uint() + 2, self.uint() + 2
            return nx, ny, self.delta(), self.delta()
        if kind == 9:
            return self.uint() + 2, 1, self.delta(), (0, 0)
        raise ValueError(f"repetition {kind} is not covered")


ONCE = (1, 1, (0, 0), (0, 0))


def decode(raw: bytes) -> Iterator[dict]:
    """Rows of kind rect, placement or error; omitted fields keep their last value."""
    try:
        c = Cursor(raw)
        if c.take(len(MAGIC)) != MAGIC:
            raise ValueError("not a layout file")
        cell, state, relative = None, {}, False
        while c.more():
            (kind,) = c.take(1)
            if kind == END:
                return
            if kind == START:
                c.string(), c.real()
                if not c.uint():
                    [c.uint() for _ in range(12)]
            elif kind in (CELL_NUMBER, CELL_NAME):
                cell = str(c.uint()) if kind == CELL_NUMBER else c.string()
                state, relative = {}, False
            elif kind in (ABSOLUTE, RELATIVE):
                relative = kind == RELATIVE
            elif kind == CBLOCK:
                c.uint()
                size, packed = c.uint(), c.uint()
                block = zlib.decompress(c.take(packed), -15)
                if len(block) != size:
                    raise ValueError("packed block has a wrong size")
                c.outer.append((c.raw, c.at))
                c.raw, c.at = block, 0
            elif kind in (RECTANGLE, PLACEMENT):
                (info,) = c.take(1)
                if kind == RECTANGLE:
                    fields = [("layer", 0, c.uint), ("datatype", 1, c.uint), ("w", 6, c.uint), ("h", 5, c.uint), ("x", 4, c.sint), ("y", 3, c.sint)]
                else:
                    fields = [("child", 7, (lambda info=info: str(c.uint()) if info & 64 else c.string())), ("px", 5, c.sint), ("py", 4, c.sint)]
                for name, bit, read in fields:
                    if info >> bit & 1:
                        value = read()
                        state[name] = value + state.get(name, 0) if relative and name in ("x", "y", "px", "py") else value
                if kind == RECTANGLE and info & 128:
                    state["h"] = state["w"]
                rep = ONCE
                if info >> (2 if kind == RECTANGLE else 3) & 1:
                    rep = state["rep"] = c.repetition(state.get("rep", ONCE))
                row = {"cell": cell, "nx": rep[0], "ny": rep[1], "vx": rep[2][0], "vy": rep[2][1], "wx": rep[3][0], "wy": rep[3][1]}
                if kind == RECTANGLE:
                    x, y = state.get("x", 0), state.get("y", 0)
                    yield row | {"kind": "rect", "layer": state["layer"], "datatype": state["datatype"], "x1": x, "y1": y, "x2": x + state["w"], "y2": y + state["h"]}
                else:
                    yield row | {"kind": "placement", "child": state["child"], "x1": state.get("px", 0), "y1": state.get("py", 0), "q": info >> 1 & 3, "flip": bool(info & 1)}
            elif kind != PAD:
                raise ValueError(f"record {kind} is not covered")
    except (ValueError, KeyError, zlib.error) as e:
        yield {"kind": "error", "message": str(e)}


SCHEMA = "path string, rec_no long, kind string, cell string, layer int, datatype int, x1 long, y1 long, x2 long, y2 long, child string, q int, flip boolean, nx long, ny long, vx long, vy long, wx long, wy long, message string"


def read(files: DataFrame) -> DataFrame:
    """The records of files (path, content), numbered in file order."""
    import pyspark.sql.pandas.types as types
    from pyspark.sql.types import StructType

    arrow = types.to_arrow_schema(StructType.fromDDL(SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[dict] = []
                for n, row in enumerate(decode(content or b"")):
                    held.append({"path": path, "rec_no": n, **row})
                    if len(held) == 20_000:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("path", "content").mapInArrow(work, SCHEMA)


def write(shapes: DataFrame) -> DataFrame:
    """(path, content): one file for each ``path`` of rectangles, in their order.

    Rows come sorted by path, so a task holds the file it is writing, no more.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rects = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([encode(path, rects)], pa.binary())], ["path", "content"])
        for batch in batches:
            for own, *rect in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != path:
                    if rects:
                        yield out()
                    path, rects = own, []
                rects.append(rect)
        if rects:
            yield out()

    rows = shapes.select("path", "layer", "datatype", "x1", "y1", "x2", "y2")
    return rows.repartition("path").sortWithinPartitions("path", "layer", "datatype", "x1", "y1").mapInArrow(work, "path string, content binary")
