"""Image folders and the directories of multi-page TIFF files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of image files; tags of width, height, bits, compression.
ENDINGS = ("bmp", "jpeg", "jpg", "png", "tif", "tiff")
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression"}
MOST_PAGES = 100_000
_SIZES = {1: 1, 3: 2, 4: 4, 16: 8}


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path): the images of one folder, by their name without ending."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join([*ENDINGS, *map(str.upper, ENDINGS)])}}}").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "path")


def pages(raw: bytes) -> Iterator[dict]:
    """One row for each directory of a classic or big TIFF file of either order."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise ValueError("not a TIFF file")
    read = lambda form, at: struct.unpack_from(order + form, raw, at)[0]
    big = read("H", 2) == 43
    number, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    at, seen = (read("Q", 8) if big else read("I", 4)), set()
    while at:
        if at in seen or len(seen) >= MOST_PAGES:
            raise ValueError("directories do not end")
        seen.add(at)
        n = read(number, at)
        row = {"page": len(seen) - 1, "offset": at}
        first = at + (8 if big else 2)
        for k in range(first, first + n * entry, entry):
            tag, kind = read("H", k), read("H", k + 2)
            if tag in TAGS and kind in _SIZES:
                count = read("Q" if big else "I", k + 4)
                value = k + (12 if big else 8)
                if count * _SIZES[kind] > word:
                    value = read("Q" if big else "I", value)
                row[TAGS[tag]] = read({1: "B", 2: "H", 4: "I", 8: "Q"}[_SIZES[kind]], value)
        yield row
        at = read("Q" if big else "I", first + n * entry)


def tiff_pages(files: DataFrame) -> DataFrame:
    """(path, page, offset, width, height, bits, compression, message) of files."""
    schema = "path string, page int, offset long, width long, height long, bits int, compression int, message string"
    kinds = pa.schema([("path", pa.string()), ("page", pa.int32()), ("offset", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("compression", pa.int32()), ("message", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    rows.extend({"path": path, **r} for r in pages(content or b""))
                except (ValueError, struct.error) as e:
                    rows.append({"path": path, "message": str(e)})
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content").mapInArrow(work, schema)
