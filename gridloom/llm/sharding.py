"""Sharding by a k-d tree over document metadata, balanced by bytes.

The rows are split at weighted medians, along the dimension that is widest among
the rows of a node, until every leaf holds its share of the bytes. A median is
found over all rows by histograms: the range of a node's keys is cut into
``BINS`` bins, the bin with the median is cut again, and so on down to one key.
A round is one aggregate for all nodes of a level; only totals by node and bin,
bounded by the number of shards, come to the driver.

Dimensions are the logarithm of the size, and the source and the language at the
share of all bytes that larger ones hold, so a width says how much is spanned.
Equal texts are a group: one point of the space, at its smallest source and
language, with the text's digest after it. A cut falls at the edge of a group. Only a
group of more than a shard's whole share is cut inside, row by row.

Two bounded steps keep the sizes near equal all the same. Groups of over one
``LARGE``-th of a share, of which there are at most ``LARGE`` for each shard, are
placed first, largest first, where most room is left; the tree then fills the
room. At the end a few groups, at most ``SPARE`` by shard and power of two of
their size, may be moved from fuller shards to emptier ones.

The law is ``bytes``: the sizes of the shards are near equal.

Defined cases: a null text counts one byte; null ids, sources and languages are
values like others; repeated rows and equal texts are one group; ties in all
dimensions are broken by the digest and then by row; a very long text is a large
group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_keys
from gridloom.operators.ordered import running_total

BITS = 30
BINS = 2048
#: Groups of more than a LARGE-th of a share are placed first.
LARGE = 32
#: Groups that the last step may move, for each shard and power of two of their size.
SPARE = 8
#: Parts of the groups of one shard and size, among which those groups are sought.
PARTS = 64
#: Shards are level enough at this difference, as a share of one.
LEVEL = 0.002
#: Rows that share one numbering task, about; the tasks grow with the rows.
NUMBERED = 20_000
_GROUP = ["tie", "text_crc32", "size"]
_TOP = (1 << BITS) - 1


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the category ``name`` replaced by its place among the bytes, from 0 to 2**BITS - 1."""
    known = cut(rows.groupBy(name).agg(F.sum("size").alias("bytes"), F.count("*").alias("_n")).withColumn("down", -F.col("bytes")))
    total = F.lit(known.agg(F.sum("bytes")).first()[0] or 1)
    placed = running_total(known, ["down", name], F.col("bytes"), "before")
    at = placed.select(name, F.floor(F.col("before") / total * _TOP).cast("long").alias(f"{name}_at"), "_n")
    return join_keys(rows, at, [name], "row").drop(name)


def metadata(docs: DataFrame) -> DataFrame:
    """One row for each document: size, dimensions ``dims``, ``tie`` and ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    log = F.least(F.floor(F.log2(size.cast("double")) / 24 * _TOP), F.lit(_TOP)).cast("long")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_{c}") for c in ("source", "lang")]
    rows = cut(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 24).alias("tie"), log.alias("_log"), *names, F.monotonically_increasing_id().alias("row")))
    rows = cut(_placed(_placed(rows, "_source"), "_lang"))
    again = rows.groupBy(*_GROUP).agg(F.min("_source_at").alias("_s"), F.min("_lang_at").alias("_l"), F.count("*").alias("_n")).where("_n > 1")
    points = join_keys(rows, again, _GROUP, "row", "left")
    return points.select("doc_id", *_GROUP, F.array("_log", F.coalesce("_s", "_source_at"), F.coalesce("_l", "_lang_at")).alias("dims"), "row")


@dataclass
class _Node:
    """A node to be cut: the range of its key's open part and what is fixed."""

    node: int
    dim: int
    want: float  # bytes of the open range that go left
    lo: int
    hi: int
    share: float  # bytes of a shard; groups of at most so many stay whole
    fixed: list[int] = field(default_factory=list)

    def state(self) -> tuple:
        a, b = (self.fixed + [None, None])[:2]
        return (self.node, self.dim, len(self.fixed), a, b, self.lo, self.hi, max(1, -(-(self.hi - self.lo + 1) // BINS)))

    def choose(self, found: list) -> None:
        """Narrow the open part to the bin that holds the cut."""
        for r in sorted(found, key=lambda r: r.bin):
            last = r
            if self.want < r.bytes:
                break
            self.want -= r.bytes
        self.lo, self.hi = last.least, last.most
        if self.lo < self.hi:
            return
        self.fixed.append(self.lo)
        self.lo, self.hi = 0, 2**62
        if len(self.fixed) == 2 and last.bytes <= self.share:
            self.fixed.append(-1 if 2 * self.want < last.bytes else self.hi)


def _small(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of few rows, bounded by the shards."""
    return F.broadcast(rows.sparkSession.createDataFrame(values, schema))


def _parts() -> list[Column]:
    return [F.get("dims", F.col("dim")), F.col("tie"), F.col("row")]


def _cuts(rows: DataFrame, aims: dict[int, float], share: float) -> list[_Node]:
    """For each node of ``aims`` the key that its share of bytes ends before."""
    spans = [F.struct((F.max(F.get("dims", F.lit(i))) - F.min(F.get("dims", F.lit(i)))).alias("w"), F.lit(-i).alias("i"), F.min(F.get("dims", F.lit(i))).alias("lo"), F.max(F.get("dims", F.lit(i))).alias("hi")) for i in range(3)]
    widest = rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.greatest(*spans).alias("s")).collect()
    nodes = [_Node(r.node, -r.s.i, aims[r.node] * r.bytes, r.s.lo, r.s.hi, share) for r in widest if r.node in aims]
    first, second, third = _parts()
    while open_ := [n for n in nodes if len(n.fixed) < 3]:
        state = _small(rows, [n.state() for n in open_], "node int, dim int, part int, a long, b long, lo long, hi long, step long")
        key = F.when(F.col("part") == 0, first).when(F.col("part") == 1, second).otherwise(third)
        inside = rows.join(state, "node").where(F.coalesce(first == F.col("a"), F.lit(True)) & F.coalesce(second == F.col("b"), F.lit(True))).withColumn("k", key).where("k between lo and hi")
        found: dict[int, list] = {}
        for r in inside.groupBy("node", F.expr("(k - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most")).collect():
            found.setdefault(r.node, []).append(r)
        for n in open_:
            n.choose(found[n.node])
    return nodes


def _tree(rows: DataFrame, room: np.ndarray, share: float) -> DataFrame:
    """``rows`` with their ``node``: the shard whose room they fill.

    A node is a range of shards, named by the first of them; its cut sends half
    of the shards to the left, with bytes by the room that is left in them.
    """
    rows = cut(rows.withColumn("node", F.lit(0)))
    ranges = [(0, len(room))]
    while any(b - a > 1 for a, b in ranges):
        right = {a: a + (b - a) // 2 for a, b in ranges if b - a > 1}
        aims = {a: float(room[a : right[a]].sum() / room[a:b].sum()) if room[a:b].sum() else 0.5 for a, b in ranges if b - a > 1}
        cuts = _small(rows, [(n.node, n.dim, *n.fixed, right[n.node]) for n in _cuts(rows, aims, share)], "node int, dim int, a long, b long, c long, right int")
        key = F.struct(*(p.alias(c) for p, c in zip(_parts(), "abc", strict=True)))
        past = F.col("right").isNotNull() & (key >= F.struct("a", "b", "c"))
        rows = cut(rows.join(cuts, "node", "left").withColumn("node", F.when(past, F.col("right")).otherwise(F.col("node"))).drop("dim", "a", "b", "c", "right"))
        ranges = [x for a, b in ranges for x in ([(a, right[a]), (right[a], b)] if b - a > 1 else [(a, b)])]
    return rows


def levelled(load: np.ndarray, spare: list[list[tuple]], near: float) -> list[tuple]:
    """Moves (key, shard) that bring the loads within ``near`` of each other, if they can.

    ``spare`` holds (bytes, key) of the groups that may leave each shard. The
    fullest shard gives a group to the emptiest, or exchanges one with it, by
    what evens the two out most; every step does, so this ends.
    """
    load, to = load.astype(float).copy(), {}
    held = [dict((key, size) for size, key in groups) for groups in spare]
    while load.max() - load.min() > near:
        a, b = int(load.argmax()), int(load.argmin())
        gap = load[a] - load[b]
        mine, theirs = list(held[a]), [None, *held[b]]
        moved = np.array([held[a][k] for k in mine], float)[:, None] - np.array([0, *held[b].values()], float)
        moved[(moved <= 0) | (moved >= gap)] = np.inf
        if not moved.size or not np.isfinite(moved).any():
            break
        i, j = np.unravel_index(np.abs(moved - gap / 2).argmin(), moved.shape)
        for key, x, y in ((mine[i], a, b), (theirs[j], b, a)):
            if key is not None:
                size = held[x].pop(key)
                held[y][key] = size
                to[key] = y
                load[x] -= size
                load[y] += size
    return list(to.items())


def _moved(rows: DataFrame, moves: list[tuple]) -> DataFrame:
    """``rows`` with the shard of the groups in ``moves`` set."""
    table = _small(rows, [(*key, shard) for key, shard in moves], "tie long, text_crc32 long, size long, to int")
    return rows.join(table, _GROUP, "left").withColumn("node", F.coalesce("to", "node")).drop("to")


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    rows = cut(metadata(docs))
    share = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    groups = cut(rows.groupBy(*_GROUP).agg(F.sum("size").alias("bytes")))
    large = groups.where((F.col("bytes") * LARGE > share) & (F.col("bytes") <= share)).orderBy(F.desc("bytes"), *_GROUP).collect()  # at most LARGE for each shard
    load, first = np.zeros(shards), []
    for r in large:
        shard = int(load.argmin())
        load[shard] += r.bytes
        first.append(((r.tie, r.text_crc32, r.size), shard))
    placed = cut(_moved(rows.withColumn("node", F.lit(-1)), first))
    tree = _tree(placed.where("node < 0").drop("node"), np.maximum(share - load, 0), share)
    loads = {r.node: r.bytes for r in tree.groupBy("node").agg(F.sum("size").alias("bytes")).collect()}
    load = load + np.array([loads.get(s, 0) for s in range(shards)])
    power = F.floor(F.log2("bytes"))
    # a group that was cut is in several nodes and stays as it is
    whole = tree.groupBy(*_GROUP).agg(F.min("node").alias("node"), F.max("node").alias("last"), F.sum("size").alias("bytes")).where("node = last")
    # first in each of many parts of the groups of one size, then among what is left of them
    parted = whole.withColumns({"power": power, "part": F.pmod("tie", F.lit(PARTS))})
    for by in (["node", "power", "part"], ["node", "power"]):
        parted = parted.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*_GROUP))).where(F.col("nth") <= SPARE)
    spare: list[list[tuple]] = [[] for _ in range(shards)]
    for r in parted.collect():
        spare[r.node].append((r.bytes, (r.tie, r.text_crc32, r.size)))
    level = _moved(tree, levelled(load, [sorted(x) for x in spare], LEVEL * share))
    return _numbered(placed.where("node >= 0").unionByName(level.select(*placed.columns)).withColumnRenamed("node", "shard"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``slot``: gapless numbers in each shard, by part and then by place in it."""
    parts = rows.count() // NUMBERED + 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    joined = dealt.withColumn("own", own).join(before, ["shard", "part"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).cast("long").alias("slot"))
