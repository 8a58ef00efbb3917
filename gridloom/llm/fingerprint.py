"""Document fingerprints: an exact digest of the canonical text.

The canonical text is the NFKC form, case folded, normalised again, with runs
of white space folded to single spaces and none at the ends. Its fingerprint is
the 128-bit xxhash in hex. Equal fingerprints are grouped, and inside a group
the canonical bytes themselves are compared, so that a collision of the hash
never joins different texts.

Defined cases: a null text counts as empty; empty texts share one fingerprint;
null ids sort first; repeated ids sort by text, and a tie of both is of equal
rows; a very long text is folded whole; an empty table gives no rows, and the
only row of a table is its own next one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_keys

#: Up to so many ids (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def canonical(text: str | None) -> str:
    """The text without differences of form, case and white space."""
    if not text:
        return ""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def fingerprint_of(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "replace"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint_of, batch.column(1).to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


def exact_groups(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, group_id): the smallest id with the same canonical text.

    Only rows whose fingerprint occurs twice move their text, once, and rows
    that are equal meet in map-side aggregates first, so a large group of
    copies is one row for each task. ``known`` may hand in the fingerprints.
    A null id is no group's smallest id unless all ids of the group are null.
    """
    marks = cut(fingerprints(docs) if known is None else known.select("doc_id", "fingerprint"))
    twice = marks.groupBy("fingerprint").agg(F.count("*").alias("_n")).where("_n > 1")
    ids = cut(join_keys(marks, twice, ["fingerprint"], "doc_id", "left_semi").select("doc_id").where("doc_id is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [canonical(t).encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_hexdigest(p) for p in plain], pa.string()), pa.array(plain, pa.binary())], ["doc_id", "fingerprint", "plain"])

    plain = texts.mapInArrow(work, "doc_id long, fingerprint string, plain binary")
    # grouping by the bytes is the comparison of the bytes
    same = cut(plain.groupBy("fingerprint", "plain").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("_n")).select("fingerprint", F.sha2("plain", 256).alias("_sha"), "group_id", "_n"))
    clash = cut(same.groupBy("fingerprint").agg(F.count("*").alias("_k"), F.min("group_id").alias("group_id"), F.sum("_n").alias("_n")))
    out = join_keys(marks, clash, ["fingerprint"], "doc_id", "left")
    alone = out.where(F.coalesce("_k", F.lit(1)) == 1).select("doc_id", "fingerprint", F.coalesce("group_id", "doc_id").alias("group_id"))
    collided = clash.where("_k > 1").select("fingerprint")
    apart = plain.join(collided, "fingerprint", "left_semi").select("doc_id", "fingerprint", F.sha2("plain", 256).alias("_sha")).join(same.drop("_n"), ["fingerprint", "_sha"]).select("doc_id", "fingerprint", "group_id")
    return alone.unionByName(apart)


def edited_copy(text: str, following: str) -> str:
    """The text with its second half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NEXT_SCHEMA = "kind string, at int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> dict:
    edited = edited_copy(text, following)
    edited_mark = fingerprint_of(edited)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), "fingerprint": mark, "edited_fingerprint": edited_mark, "near_edited": float(mark == edited_mark), "near_next": float(mark == next_mark)}


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Rows are dealt out by ranges of ids and sorted inside each, so the next
    document is the next row; rows that share an id, or have none, follow each other
    by hashes of their texts, so that many of them do not meet in one task. The last row of a range meets the first row of
    the next range that has rows in a join of two rows for each range.
    """
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId(), None
        names = [part.split()[0] for part in _NEXT_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint_of(text)
                if held is None:
                    rows.append({"kind": "head", "at": at, "text": text})
                else:
                    rows.append({"kind": "row", **_row(*held, text, mark)})
                held = (doc_id, text, mark)
            yield out(rows)
        if held is not None:
            yield out([{"kind": "tail", "at": at, "doc_id": held[0], "text": held[1]}])

    rows = cut(dealt.mapInArrow(work, _NEXT_SCHEMA))
    heads = rows.where("kind = 'head'")
    order = heads.select("at").withColumn("_next", F.lead("at").over(Window.orderBy("at"))).withColumn("_next", F.coalesce("_next", F.min("at").over(Window.partitionBy())))
    ends = rows.where("kind = 'tail'").select("at", "doc_id", "text").join(order, "at").join(heads.select(F.col("at").alias("_next"), F.col("text").alias("_text")), "_next").select("doc_id", "text", "_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_row(i, t, fingerprint_of(t), n, fingerprint_of(n)) for i, t, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
            if done:
                yield pa.RecordBatch.from_pylist(done)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    closed = ends.mapInArrow(close, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return rows.where("kind = 'row'").select(*names).unionByName(closed)


def summarize(docs: DataFrame) -> DataFrame:
    """:func:`against_next` with the group of equal canonical texts."""
    rows = cut(against_next(docs))
    groups = exact_groups(docs, rows).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("group_id"))
    keyed = rows.alias("r").join(groups.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.fingerprint") == F.col("g.fingerprint")), "left")
    return keyed.select("r.*", "g.group_id")
