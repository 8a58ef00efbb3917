"""Merkle manifest of a dataset, by time-forward processing in two sweeps.

Every row is a leaf, every ``lang`` a tree, and the roots of the trees are the leaves
of one tree on top. A node's label is where its leaves end, then its height, so
children come before their parents. A digest is sent to its parent as a message in
a priority queue ordered by label; once the sweep has come to a label, all messages
to that node are at the front of the queue and make its digest. The queue is held
in two parts. Messages inside a block of ``ARITY ** LEVELS`` leaves wait in a heap, at
most ``ARITY`` for each level, as labels come in order. Messages to other
blocks are rows: the root of a block is a leaf of the next round, dealt by block and
sorted by label by Spark. A second sweep takes the rounds backwards: a block gets one
message with the proof suffix of its root, and its nodes, in reversed order of
their labels, hand their siblings on to the leaves.

No task sees more than the blocks dealt to it, however large one language is, and
every round is written to the shared folder. There is one more round for each block's
length by which the largest tree grows.

Defined results: null values are digested as ``-``, so they differ from empty
texts; rows without ``lang`` form the first tree; rows without ``doc_id`` come first
in their tree; rows that share an id are ordered by their digests, and rows that
are equal throughout get neighbouring places. A tree of one leaf has that leaf as
its root, and a dataset of one tree has that tree's root. Texts are digested whole,
whatever their length. An empty table gives no rows. Other columns are not looked
at, so that they may have any name.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, measured

#: Children of a node, and levels of a block.
ARITY, LEVELS = 8, 3
#: The columns that a leaf digests, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(values: dict[str, Column] | None = None) -> Column:
    """The leaf of a row, as 32 bytes; ``values`` takes the place of columns."""
    found = {c: (values or {}).get(c, F.col(c)).cast("string") for c in COLUMNS}
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in found.values()]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def as_text(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``slot``, a row's place in its group from 0, and ``n``, the rows of its group.

    Rows are dealt by ranges of the whole order, so a large group has many tasks;
    a window sees one range, and one row for each group and range is summed up.
    """
    ranged = cut(rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_held"))
    groups = Window.partitionBy(by)
    before = groups.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"), F.sum("_held").over(groups).alias("n"))
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range", by).orderBy(*order)) - 1)
    placed = inside.join(starts, (F.col("_range") == F.col("_r")) & (F.col(by) == F.col("_by")))
    return cut(placed.withColumn("slot", F.col("_start") + F.col("_in")).drop("_range", "_in", "_r", "_by", "_start"))


def levels_of(n: int) -> int:
    """Levels from ``n`` nodes up to one."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def forward(leaves: list[str], levels: int) -> list[tuple[int, int, list[str]]]:
    """(height, number, children's digests) of a block's nodes, in the order of their labels."""
    out: list[tuple[int, int, list[str]]] = []
    queue: list[tuple[int, int, int, str]] = []

    def send(height: int, number: int, value: str) -> None:
        """To the parent: the label is where its leaves end, and its height."""
        if height < levels:
            heappush(queue, ((number // ARITY + 1) * ARITY ** (height + 1), height + 1, number, value))

    def deliver(until: float) -> None:
        while queue and queue[0][0] <= until:
            end, height = queue[0][:2]
            children = []
            while queue and queue[0][:2] == (end, height):
                children.append(heappop(queue)[3])
            number = end // ARITY**height - 1
            out.append((height, number, children))
            send(height, number, digest(children))

    for number, value in enumerate(leaves):
        deliver(number)
        send(0, number, value)
    deliver(float("inf"))
    return out


def backward(nodes: list[tuple[int, int, list[str]]], levels: int, suffix: list) -> dict[int, list]:
    """The proof of every leaf of a block: its siblings by level, then ``suffix``."""
    sent = {(levels, 0): suffix}
    for height, number, children in reversed(nodes):
        rest = sent.pop((height, number))
        for k in range(len(children)):
            own = {"left": "".join(children[:k]), "right": "".join(children[k + 1 :])}
            sent[height - 1, number * ARITY + k] = [own, *rest]
    return {number: path for (_, number), path in sent.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches sorted by tree and block."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not len(rows):
            continue
        tree, block = np.array(rows["tree"].to_pylist(), object), rows["block"].to_numpy()
        edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (tree[1:] != tree[:-1])) + 1).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(edges[-1])
    if held is not None and len(held):
        yield held


def _hexes(column: pa.ChunkedArray) -> list[str]:
    return [v.hex() for v in column.to_pylist()]


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _block(levels: int) -> Column:
    return F.floor(F.col("slot") / ARITY**levels).cast("long").alias("block")


def _rounds(nodes: DataFrame, most_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The leaves of each round, and the roots of all trees."""
    shape = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("slot", pa.int64()), ("digest", pa.binary())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            n, leaves = rows["n"][0].as_py(), _hexes(rows["digest"])
            found = forward(leaves, min(most_levels, levels_of(n)))
            root = digest(found[-1][2]) if found else leaves[0]
            row = {"tree": rows["tree"][0].as_py(), "n": -(-n // ARITY**most_levels), "slot": rows["block"][0].as_py(), "digest": bytes.fromhex(root)}
            yield pa.RecordBatch.from_pylist([row], shape)

    rounds = []
    while True:
        rounds.append(nodes)
        lifted = _dealt(nodes.select("tree", "n", "slot", "digest", _block(most_levels)), "slot").mapInArrow(up, "tree string, n long, slot long, digest binary")
        nodes, seen = measured(lifted, most=F.coalesce(F.max("n"), F.lit(0)))
        if seen["most"] <= 1:
            return rounds, nodes


def _send_down(nodes: DataFrame, above: DataFrame, extra: list[str], most_levels: int) -> DataFrame:
    """(tree, slot, digest, path, subroot, root, extra): the leaves of a round with their proofs.

    ``above`` has one row for each block: tree, slot (the block), path, subroot, root.
    """
    leaves = nodes.select("tree", _block(most_levels), F.lit(1).alias("kind"), "slot", "n", "digest", F.lit(None).cast(_PATH).alias("path"), *(F.lit(None).cast("string").alias(c) for c in ("subroot", "root")), *extra)
    heads = above.select("tree", F.col("slot").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), "path", "subroot", "root", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra))
    types = {f.name: f.dataType.simpleString() for f in leaves.schema}
    shape = ", ".join(f"{c} {types[c]}" for c in ("tree", "slot", "digest", "path", "subroot", "root", *extra))
    kinds = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            head, own = rows.slice(0, 1), rows.slice(1)
            levels = min(most_levels, levels_of(own["n"][0].as_py()))
            paths = backward(forward(_hexes(own["digest"]), levels), levels, head["path"][0].as_py())
            found = {"path": pa.array([paths[k] for k in range(len(own))], kinds)}
            found |= {c: pa.array([head[c][0].as_py()] * len(own), pa.string()) for c in ("subroot", "root")}
            out = pa.table({c: found.get(c, own[c]) for c in ("tree", "slot", "digest", "path", "subroot", "root", *extra)})
            yield from out.combine_chunks().to_batches()

    return _dealt(leaves.unionByName(heads), "kind", "slot").mapInArrow(down, shape)


def prove(leaves: DataFrame, extra: list[str], levels: int = LEVELS) -> DataFrame:
    """(tree, slot, digest, path, subroot, root, extra) of leaves (tree, n, slot, digest, extra).

    ``path`` holds for each level the digests of a run's other nodes, those to the
    left and those to the right joined; :func:`folded` gives the root from it.
    """
    rounds, roots = _rounds(leaves, levels)
    top = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "tree", ["key"])
    above_rounds, root = _rounds(top, levels)
    none = F.array().cast(_PATH)
    above = root.select("tree", "slot", none.alias("path"), F.lit(None).cast("string").alias("subroot"), as_text("digest").alias("root"))
    for nodes in reversed(above_rounds[1:]):
        above = cut(_send_down(nodes, above, [], levels).drop("digest"))
    subroots = _send_down(above_rounds[0], above, ["key"], levels)
    above = cut(subroots.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("slot"), "path", as_text("digest").alias("subroot"), "root"))
    for nodes in reversed(rounds[1:]):
        above = cut(_send_down(nodes, above, [], levels).drop("digest"))
    return _send_down(rounds[0], above, extra, levels)


def folded(path: str | Column, start: Column) -> Column:
    """The root that a leaf and its proof lead to, as text."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def manifest(docs: DataFrame, levels: int = LEVELS, **extra: Column) -> DataFrame:
    """(doc_id, tree, slot, leaf, path, subroot, root, extra): every row of ``docs`` and its proof.

    ``tree`` is ``=`` and the language, or empty without one; ``extra`` are further
    columns of the rows, taken along.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = cut(docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), *(v.alias(k) for k, v in extra.items())))
    proved = prove(numbered(leaves, "tree", ["doc_id", "digest"]), ["doc_id", *extra], levels)
    return proved.select("doc_id", "tree", "slot", as_text("digest").alias("leaf"), "path", "subroot", "root", *extra)


def summarize(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest, checked again after the capitals of a third of the texts were changed."""
    tampered = leaf_digest({"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)})
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, levels, changed=F.when(due, tampered))
    again = folded("path", F.coalesce(as_text("changed"), F.col("leaf")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
