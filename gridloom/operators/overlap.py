"""Joining boxes that overlap, by grid squares instead of a nested loop.

Shapes and queries both have a level by their size; squares of a level are four
times as wide as those below. A pair meets at the coarser of its two levels, where the
smaller box lives in the one square of its lower corner and the other looks into
the at most nine squares from which it could be touched. So no pair comes twice,
and the rows of a query do not grow with its size. Squares that hold very many
shapes are dealt to parts, and queries are copied to the parts of the squares they
look into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A level's squares are so many times as wide as those of the level below.
STEP = 4
#: Shapes of a square beyond which, and beyond a HOT-th of all, it is dealt to parts.
PART_ROWS, HOT = 20_000, 1000
_MEET = ["_level", "_kind", "_bx", "_by"]


def normalized(x1, y1, x2, y2) -> list[Column]:
    """A box with its corners in order."""
    c = [F.col(v) if isinstance(v, str) else v for v in (x1, y1, x2, y2)]
    return [F.least(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[0], c[2]), F.greatest(c[1], c[3])]


def touches(a: list[Column], b: list[Column]) -> Column:
    """Whether two ordered boxes overlap; touching edges count."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def _size(box: list[Column]) -> Column:
    return F.greatest(box[2] - box[0], box[3] - box[1]).cast("double")


def _width(level: Column, grid: int) -> Column:
    return F.lit(float(grid)) * F.pow(F.lit(float(STEP)), level)


def with_level(rows: DataFrame, box: list[Column], grid: int, level: str) -> DataFrame:
    """``level``: the lowest level whose squares are as wide as the box; null for a box without size.

    In steps with columns of their own, so that no step's code repeats the one before.
    """
    sized = rows.withColumn("_size", _size(box))
    near = sized.withColumn("_near", F.when(F.col("_size") <= grid, 0).otherwise(F.ceil(F.log(float(STEP), F.col("_size") / grid)).cast("int")))
    # logarithms are not exact
    return near.withColumn(level, F.when(F.col("_size").isNotNull(), F.col("_near") + (F.col("_size") > _width(F.col("_near"), grid)).cast("int"))).drop("_near")


def _home(box: list[Column], level: Column, kind: int, grid: int) -> Column:
    at = lambda c: F.floor(c / _width(level, grid)).cast("long")
    return F.struct(level.alias("_level"), F.lit(kind).alias("_kind"), at(box[0]).alias("_bx"), at(box[1]).alias("_by"))


def _looks(box: list[Column], level: Column, kind: int, grid: int, reach: Column) -> Column:
    """The squares in which a box of at most ``reach`` that touches this one may live."""
    at = lambda c: F.floor(c / _width(level, grid)).cast("long")
    columns, rows = (F.sequence(at(box[i] - reach), at(box[i + 2])) for i in (0, 1))
    return F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(level.alias("_level"), F.lit(kind).alias("_kind"), x.alias("_bx"), y.alias("_by")))))


@dataclass
class Meeting:
    """Where boxes meet: the levels of both sides, and what the squares hold."""

    shape_levels: list[int]
    query_levels: list[int]
    reach: dict[int, float]
    most: int
    hot: list[tuple]

    def largest(self, level: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, v in self.reach.items():
            out = F.when(level == k, float(v)).otherwise(out)
        return F.coalesce(out, F.lit(0.0))


def _among(levels: list[int], above: Column, strictly: bool) -> Column:
    each = F.array(*map(F.lit, levels)).cast("array<int>")
    return F.filter(each, lambda k: k > above if strictly else k >= above)


def meeting(shapes: DataFrame, queries: DataFrame, grid: int, part_rows: int = PART_ROWS) -> Meeting:
    """What :func:`bbox_join` needs to know, by a pass over the queries and one over the shapes for each of their levels.

    Only the levels, one size for each, and the hot squares come back, of which there
    are at most HOT for each level.
    """
    s, q = normalized("x1", "y1", "x2", "y2"), normalized("qx1", "qy1", "qx2", "qy2")
    query_levels = sorted(r[0] for r in with_level(queries, q, grid, "_asked").select("_asked").distinct().collect() if r[0] is not None)
    sized = with_level(shapes, s, grid, "own").select("own", F.col("_size").alias("size"), *(c.alias(n) for c, n in zip(s[:2], "xy", strict=True)))
    m = Meeting([], query_levels, {}, 0, [])
    for level in query_levels:
        homes = _home([F.col("x"), F.col("y")], F.lit(level), 0, grid)
        lives = F.col("own") <= level
        squares = sized.groupBy(homes["_bx"].alias("bx"), homes["_by"].alias("by")).agg(F.count_if(lives).alias("n"), F.max(F.when(lives, F.col("size"))).alias("size"), F.max("own").alias("top"))
        seen = squares.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.max("size").alias("size"), F.max("top").alias("top")).first()
        if seen.top is None:
            continue
        least = max(part_rows, seen.total // HOT)
        m.reach[level], m.most = seen["size"] or 0.0, max(m.most, seen.most)
        if seen.most > least:
            m.hot += [(level, r.bx, r.by, -(-r.n // least)) for r in squares.where(F.col("n") > least).collect()]
        if not m.shape_levels:
            m.shape_levels = [seen.top] if seen.top <= query_levels[0] else sorted(r[0] for r in sized.select("own").distinct().collect() if r[0] is not None)
    return m


def bbox_join(shapes: DataFrame, queries: DataFrame, grid: int, known: Meeting | None = None) -> DataFrame:
    """Pairs of a shape (x1, y1, x2, y2) and a query (qx1, qy1, qx2, qy2) that touch.

    ``grid`` should be near the size of most queries. Shapes of at most a query's level
    are looked up by the query; larger ones look for the query.
    """
    m = known or meeting(shapes, queries, grid)
    s, q = normalized("x1", "y1", "x2", "y2"), normalized("qx1", "qy1", "qx2", "qy2")
    larger = bool(m.query_levels) and any(k > m.query_levels[0] for k in m.shape_levels)
    if len(m.query_levels) == 1 and not larger:
        only = F.lit(m.query_levels[0])  # outer explodes below infer no filters, which would repeat all that leads to the squares
        homed = shapes.withColumns({c: _home(s, only, 0, grid)[c] for c in _MEET})
        looks = _looks(q, only, 0, grid, F.lit(m.reach.get(m.query_levels[0], 0.0)))
        spread = queries.withColumn("_c", F.explode_outer(looks)).select("*", "_c.*").drop("_c")
    else:
        own, asked = F.col("_own"), F.col("_asked")
        homes = F.transform(_among(m.query_levels, own, False), lambda k: _home(s, k, 0, grid))
        # a smaller query is at least a step smaller
        wide = F.when(own > (m.query_levels or [0])[0], _looks(s, own, 1, grid, _width(own, grid) / STEP))
        homed = with_level(shapes, s, grid, "_own").withColumn("_c", F.explode_outer(F.concat(homes, F.coalesce(wide, F.slice(homes, 1, 0))) if larger else homes))
        looks = _looks(q, asked, 0, grid, m.largest(asked))
        if larger:
            looks = F.concat(looks, F.transform(_among(m.shape_levels, asked, True), lambda k: _home(q, k, 1, grid)))
        spread = with_level(queries, q, grid, "_asked").withColumn("_c", F.explode_outer(looks))
        homed, spread = (rows.select("*", "_c.*").drop("_c", "_size", "_own", "_asked") for rows in (homed, spread))
    on = _MEET
    if m.hot:
        on = [*_MEET, "_part"]
        hot = F.broadcast(shapes.sparkSession.createDataFrame(m.hot, "_level int, _bx long, _by long, _parts long").withColumn("_kind", F.lit(0)))
        dealt = F.coalesce(F.pmod(F.xxhash64(*s), F.col("_parts")), F.lit(0))
        homed = homed.join(hot, _MEET, "left").withColumn("_part", dealt).drop("_parts")
        spread = spread.join(hot, _MEET, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return homed.join(spread, on).where(touches(s, q)).drop(*on)


def union_box(*, prefix: str = "") -> list[Column]:
    """Aggregates of the box around a group; null if the group is empty."""
    lows = [F.min(F.least(f"{prefix}{a}1", f"{prefix}{a}2")).alias(f"{a}1") for a in "xy"]
    highs = [F.max(F.greatest(f"{prefix}{a}1", f"{prefix}{a}2")).alias(f"{a}2") for a in "xy"]
    return [*lows, *highs]
