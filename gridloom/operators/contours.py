"""Outlines of regions: directed edges around disjoint boxes, joined to rings.

Sides that two boxes share cancel; what is left are edges with the region on their
left. An edge is followed by one that starts where it ends; where two do, as regions
touch at a corner, by the one to the left, so that regions joined by a corner alone
have rings of their own. Edges are sorted by where they start, and chunks of that
order are followed as far as they go in Arrow tasks, which ends most rings. Paths
that lead out of their chunk are joined by pointer doubling, in as many rounds as
the number of paths of the longest ring has binary digits, whatever tiles its edges
come from. Outer rings run against the clock and holes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import kept

#: Edges that are followed at once.
CHUNK = 200_000


def edges(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, sx, sy, ex, ey): the directed edges around disjoint boxes (by, x1, y1, x2, y2).

    A side adds its sign over its stretch; sums along each line of sides leave what
    does not cancel. Neighbouring stretches of one sign are one.
    """
    ends = [(up, f"{across}{i}", f"{along}{j}", 1 if i == j else -1) for up, across, along in ((True, "x", "y"), (False, "y", "x")) for i in (1, 2) for j in (1, 2)]
    marks = boxes.select(*by, F.explode(F.array(*(F.struct(F.lit(up).alias("up"), F.col(a).alias("at"), F.col(b).alias("low"), F.lit(d).alias("d")) for up, a, b, d in ends))).alias("_m")).select(*by, "_m.*")
    steps = marks.repartition(*by, "up", "at").groupBy(*by, "up", "at", "low").agg(F.sum("d").alias("d")).where("d <> 0")
    line = Window.partitionBy(*by, "up", "at").orderBy("low")
    summed = steps.withColumn("sign", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("high", F.lead("low").over(line))
    down = F.col("up") == (F.col("sign") > 0)
    start, end = F.when(down, F.col("high")).otherwise(F.col("low")), F.when(down, F.col("low")).otherwise(F.col("high"))
    place = [F.when(F.col("up"), a).otherwise(b) for a, b in ((F.col("at"), start), (start, F.col("at")), (F.col("at"), end), (end, F.col("at")))]
    return summed.where("sign <> 0").select(*by, *(c.alias(n) for c, n in zip(place, ("sx", "sy", "ex", "ey"), strict=True)))


def _doubled(after: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least value on the way from each row, where rows without another after them lead to themselves.

    Each round looks twice as far; if it finds nothing less anywhere, nothing less is to be found.
    """
    while True:
        further = np.minimum(least, least[after])
        if (further == least).all():
            return least
        least, after = further, after[after]


def _followed(group: np.ndarray, s: np.ndarray, e: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk's edges: each one's path, its place there, whether the path is a whole ring, and the path's length.

    Edges that start at one point are all in one chunk, or none of them. A ring is
    named and begins with its least id; other paths by their first edge.
    """
    n = len(ids)
    order = np.lexsort((np.r_[s[:, 1], e[:, 1]], np.r_[s[:, 0], e[:, 0]], np.r_[group, group]))
    g, x, y = (v[order] for v in (np.r_[group, group], np.r_[s[:, 0], e[:, 0]], np.r_[s[:, 1], e[:, 1]]))
    point = np.empty(2 * n, np.int64)
    point[order] = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) - 1
    starts = np.argsort(point[:n], kind="stable")
    first, past = (np.searchsorted(point[:n][starts], point[n:], side) for side in ("left", "right"))
    way = e - s
    after, turn = np.full(n, -1), np.full(n, -np.inf)
    for k in range(int((past - first).max(initial=0))):  # two at most
        at = np.flatnonzero(first + k < past)
        other = starts[first[at] + k]
        left = way[at, 0] * way[other, 1] - way[at, 1] * way[other, 0]
        better = left > turn[at]
        after[at[better]], turn[at[better]] = other[better], left[better]
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    own = np.arange(n)
    back = np.where(before >= 0, before, own)
    # a path has an end without a row before it, which is less than all numbers of rings
    mark = _doubled(back, np.where(before < 0, -1, own))
    closed = mark >= 0
    least = _doubled(np.where(closed, after, own), ids)
    back = np.where(closed & (least == ids), own, back)
    steps = (back != own).astype(np.int64)
    while (back != back[back]).any():
        steps, back = steps + steps[back], back[back]
    return ids[back], steps, closed, np.bincount(back, minlength=n)[back]


def _paths(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """The rows with their path, place, closed and length; dealt by ranges of where they start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table[c].to_numpy() for c in (*by, "sx", "sy")]
            fresh = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            stop = len(table) if last else int(np.flatnonzero(fresh)[-1])
            held = table.slice(stop).to_batches()
            if stop:
                table, group = table.slice(0, stop), np.zeros(stop, np.int64)
                for k in keys[:-2]:
                    group[1:] += np.cumsum(k[1:stop] != k[: stop - 1])  # sorted by these first
                s, e = (np.stack([table[c].to_numpy().astype(float) for c in names], axis=1) for names in (("sx", "sy"), ("ex", "ey")))
                found = _followed(group, s, e, table["id"].to_numpy())
                for name, column in zip(("path", "place", "closed", "length"), found, strict=True):
                    table = table.append_column(name, pa.array(column))
                yield from table.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= size:
                    yield from chunk(False)
        if held:
            yield from chunk(True)

    dealt = rows.repartitionByRange(*by, "sx", "sy").sortWithinPartitions(*by, "sx", "sy")
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return dealt.mapInArrow(work, f"{fields}, path long, place long, closed boolean, length long")


def _joined(paths: DataFrame, by: list[str]) -> DataFrame:
    """(path, ring, skipped, around): the open paths in rings; the edges of a ring before each, from its least id, and all of them.

    ``paths`` has one row each: (by, path, least, least_place, length), the first edge's
    point and direction (fx, fy, fdx, fdy) and the last one's (lx, ly, ldx, ldy).
    """
    after = paths.select(*by, F.col("fx").alias("lx"), F.col("fy").alias("ly"), F.col("path").alias("next"), "fdx", "fdy")
    turn = F.col("ldx") * F.col("fdy") - F.col("ldy") * F.col("fdx")
    linked = kept(paths.drop("fx", "fy", "fdx", "fdy").join(after, [*by, "lx", "ly"]).groupBy("path", "least", "least_place", "length").agg(F.max_by("next", turn).alias("next")))
    state = linked.select("path", "next", "least", F.col("least").alias("head"))
    while True:  # the least id of twice as many paths each round
        ahead = state.select(F.col("path").alias("next"), F.col("next").alias("_next"), F.col("head").alias("_head"))
        further = state.join(ahead, "next").select("path", F.col("_next").alias("next"), "least", F.least("head", "_head").alias("head"), (F.col("_head") < F.col("head")).alias("_moved"))
        further = kept(further)
        state = further.drop("_moved")
        if further.where("_moved").isEmpty():
            break
    # edges after each path up to where the ring's path with the least id comes next
    known = linked.join(state.select("path", "head"), "path")
    ahead = known.select(F.col("path").alias("next"), F.col("length").alias("_length"), (F.col("least") == F.col("head")).alias("_first"))
    ranked = kept(known.join(ahead, "next").select("path", "head", "length", F.when(~F.col("_first"), F.col("next")).alias("next"), F.when(F.col("_first"), 0).otherwise(F.col("_length")).alias("left")))
    while not ranked.where("next is not null").isEmpty():
        ahead = ranked.select(F.col("path").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        ranked = kept(ranked.join(ahead, "next", "left").select("path", "head", "length", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    sizes = ranked.groupBy("head").agg(F.sum("length").alias("around"))
    offset = known.where("least = head").select("head", "least_place")
    return ranked.join(sizes, "head").join(offset, "head").select("path", F.col("head").alias("ring"), (F.col("around") - F.col("left") - F.col("length") - F.col("least_place")).alias("skipped"), "around")


def rings(boxes: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """(by, ring, seq, x, y, nx, ny): the corners of every ring, in order, with the next corner.

    Without ``by`` all boxes are one region, whatever windows they were worked out in.
    """
    found = kept(_paths(kept(edges(boxes, by).withColumn("id", F.monotonically_increasing_id())), by, chunk))
    corner = [*by, "ring", "seq", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("ex").alias("nx"), F.col("ey").alias("ny")]
    out = found.where("closed").withColumns({"ring": F.col("path"), "seq": F.col("place")}).select(*corner)
    open_ = found.where("not closed")
    if open_.isEmpty():
        return out
    ends = {"first": F.col("place") == 0, "last": F.col("place") == F.col("length") - 1}
    of = lambda end, c: F.max(F.when(ends[end], c))
    way = {"dx": F.col("ex") - F.col("sx"), "dy": F.col("ey") - F.col("sy")}
    sides = {"fx": of("first", F.col("sx")), "fy": of("first", F.col("sy")), "lx": of("last", F.col("ex")), "ly": of("last", F.col("ey")), **{f"f{k}": of("first", v) for k, v in way.items()}, **{f"l{k}": of("last", v) for k, v in way.items()}}
    paths = open_.groupBy(*by, "path", "length").agg(F.min("id").alias("least"), F.min_by("place", "id").alias("least_place"), *(v.alias(k) for k, v in sides.items()))
    joined = _joined(kept(paths), by)
    return out.unionByName(open_.join(joined, "path").withColumn("seq", F.pmod(F.col("skipped") + F.col("place"), F.col("around"))).select(*corner))


def ring_facts(corners: DataFrame, by: list[str]) -> DataFrame:
    """(by, ring, n_corners, area): one row a ring; the area of a hole is negative."""
    area = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2
    return corners.groupBy(*by, "ring").agg(F.count(F.lit(1)).alias("n_corners"), area.alias("area"))
