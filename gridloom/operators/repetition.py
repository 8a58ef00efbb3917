"""Array descriptors: counts, extents, expansion and clipped expansion.

A descriptor has ``nx`` by ``ny`` steps along (vx, vy) and (wx, wy). Lists of
gaps or offsets are arrays; they become offsets by a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.overlap import touches


def count() -> Column:
    return F.col("nx") * F.col("ny")


def extent() -> list[Column]:
    """Smallest and largest offset of the array, without expanding it."""
    out = []
    for pick in (F.least, F.greatest):
        for v, w in (("vx", "wx"), ("vy", "wy")):
            a, b = (F.col("nx") - 1) * F.col(v), (F.col("ny") - 1) * F.col(w)
            out.append(pick(F.lit(0), a, b, a + b))
    return out


def _placed(i: Column, j: Column) -> list[Column]:
    return [i * F.col("vx") + j * F.col("wx"), i * F.col("vy") + j * F.col("wy")]


def expand(arrays: DataFrame) -> DataFrame:
    """One row for each element, numbered j outer and i inner."""
    rows = arrays.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    dx, dy = _placed(F.col("i"), F.col("j"))
    return rows.withColumns({"dx": dx, "dy": dy})


def box_of(dx: str = "dx", dy: str = "dy") -> list[Column]:
    return [F.col("x1") + F.col(dx), F.col("y1") + F.col(dy), F.col("x2") + F.col(dx), F.col("y2") + F.col(dy)]


def _index_range(low: Column, high: Column, step: str, n: str) -> tuple[Column, Column]:
    """First and last index along one axis that can reach [low, high]; padded by one."""
    s = F.col(step)
    first = F.greatest(F.lit(0), F.floor(low / s) - 1).cast("long")
    last = F.least(F.col(n) - 1, F.ceil(high / s) + 1).cast("long")
    return F.when(s > 0, first).otherwise(F.lit(0)), F.when(s > 0, last).otherwise(F.col(n) - 1)


def clipped(arrays: DataFrame, size: int) -> DataFrame:
    """Elements that touch the query box at (qx1, qy1) of that size.

    Arrays whose extent misses the box are dropped before they are expanded, and
    only indices that can reach it are generated; the box then decides. Works
    along vx and wy with the cross steps taken into account as slack.
    """
    low_x, low_y, high_x, high_y = extent()
    query = [F.col("qx1"), F.col("qy1"), F.col("qx1") + size, F.col("qy1") + size]
    whole = [F.col("x1") + low_x, F.col("y1") + low_y, F.col("x2") + high_x, F.col("y2") + high_y]
    near = arrays.where(touches(whole, query))
    slack_x, slack_y = F.abs(F.col("wx")) * (F.col("ny") - 1), F.abs(F.col("vy")) * (F.col("nx") - 1)
    i0, i1 = _index_range(query[0] - F.col("x2") - slack_x, query[2] - F.col("x1") + slack_x, "vx", "nx")
    j0, j1 = _index_range(query[1] - F.col("y2") - slack_y, query[3] - F.col("y1") + slack_y, "wy", "ny")
    rows = near.withColumns({"_i0": i0, "_i1": i1, "_j0": j0, "_j1": j1}).where("_i0 <= _i1 and _j0 <= _j1")
    rows = rows.withColumn("j", F.explode(F.sequence("_j0", "_j1"))).withColumn("i", F.explode(F.sequence("_i0", "_i1")))
    dx, dy = _placed(F.col("i"), F.col("j"))
    rows = rows.withColumns({"dx": dx, "dy": dy}).drop("_i0", "_i1", "_j0", "_j1")
    return rows.where(touches(box_of(), query))


def running(gaps: str) -> Column:
    """Offsets from gaps: 0, then their running sums."""
    summed = F.aggregate(gaps, F.array(F.lit(0).cast("long")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g)))
    return summed


def doubly_running(steps: str) -> Column:
    """Points from changes of the step: each number is added to the step before, and that to the point before."""
    taken = F.slice(running(steps), 2, F.size(steps))
    return F.aggregate(taken, F.array(F.lit(0).cast("long")), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g)))


def plan_kind(limit: int = 4096) -> Column:
    """How an array is best treated: as a grid, expanded, or left alone."""
    straight = (F.col("vy") == 0) & (F.col("wx") == 0)
    return F.when(straight, "grid").when(count() <= limit, "expand").otherwise("bail")


#: Types of repetitions by lists; along x, along y, or both, and those on a grid.
ALONG_X, ALONG_Y, FREE, ON_GRID = (4, 5), (6, 7), (10, 11), (5, 7, 11)


def expand_lists(arrays: DataFrame) -> DataFrame:
    """One row for each element of (rtype, grid, gaps_x, gaps_y), with ``step``, ``dx`` and ``dy``.

    The first element is at the origin; each gap leads to the next one. Types along
    one axis have their gaps in ``gaps_x``; both lists hold free offsets.
    """
    unit = F.when(F.col("rtype").isin(*ON_GRID), F.col("grid")).otherwise(F.lit(1))
    first, second = running("gaps_x"), running("gaps_y")
    still = F.transform(first, lambda _: F.lit(0).cast("long"))
    dx = F.when(F.col("rtype").isin(*ALONG_Y), still).otherwise(first)
    dy = F.when(F.col("rtype").isin(*ALONG_X), still).when(F.col("rtype").isin(*ALONG_Y), first).otherwise(second)
    rows = arrays.withColumns({"_dx": dx, "_dy": dy, "_unit": unit})
    rows = rows.select("*", F.posexplode(F.arrays_zip("_dx", "_dy")).alias("step", "_o"))
    return rows.withColumns({"dx": F.col("_o._dx") * F.col("_unit"), "dy": F.col("_o._dy") * F.col("_unit")}).drop("_dx", "_dy", "_unit", "_o")
