"""Tiles of a chip, shapes cut to them, and windows split where shapes are dense."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.ordered import kept
from gridloom.operators.overlap import bbox_join

#: Fixed value: at most so many tiles along an axis.
MOST = 64
#: Shapes near a part of a window beyond which it is split.
MOST_SHAPES = 20_000
_BOX = ("x1", "y1", "x2", "y2")


def box_of(shapes: DataFrame) -> tuple[int, int, int, int]:
    """The box around all shapes, as four numbers; a point where there are none."""
    found = shapes.agg(F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    return tuple(int(v or 0) for v in found)


def tile_grid(spark: SparkSession, box: tuple[int, int, int, int], target: int) -> DataFrame:
    """(window_id, wx1..wy2): near-square tiles, row by row; the last ends exactly."""
    x1, y1, x2, y2 = box
    nx, ny = (min(MOST, max(1, math.ceil((b - a) / target))) for a, b in ((x1, x2), (y1, y2)))
    ids = spark.range(nx * ny).select(F.col("id").alias("window_id"), (F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    edge = lambda k, a, b, n: F.when(F.col(k) >= n, F.lit(b)).otherwise(F.lit(a) + F.floor(F.col(k) * ((b - a) / n))).cast("long")
    ends = ids.withColumns({"i1": F.col("i") + 1, "j1": F.col("j") + 1})
    return ends.select("window_id", edge("i", x1, x2, nx).alias("wx1"), edge("j", y1, y2, ny).alias("wy1"), edge("i1", x1, x2, nx).alias("wx2"), edge("j1", y1, y2, ny).alias("wy2"))


def clip_to_tiles(shapes: DataFrame, tiles: DataFrame, grid: int) -> DataFrame:
    """Parts of positive area of each shape in each tile."""
    queries = tiles.select("window_id", *(F.col(f"w{c}").alias(f"q{c}") for c in ("x1", "y1", "x2", "y2")))
    joined = bbox_join(shapes, queries, grid)
    cut = {"x1": F.greatest("x1", "qx1"), "y1": F.greatest("y1", "qy1"), "x2": F.least("x2", "qx2"), "y2": F.least("y2", "qy2")}
    return joined.select(*(c for c in joined.columns if c not in cut and not c.startswith("q")), *(v.alias(k) for k, v in cut.items())).where("x2 > x1 and y2 > y1")


def reaching(parts: DataFrame, halo_nm: float) -> DataFrame:
    """The parts with their boxes and a halo as queries (qx1..qy2)."""
    return parts.select("*", *((F.col(f"p{c}") + s * halo_nm).alias(f"q{c}") for c, s in zip(_BOX, (-1, -1, 1, 1), strict=True)))


def split_windows(windows: DataFrame, shapes: DataFrame, halo_nm: float, grid: int, most: int = MOST_SHAPES) -> DataFrame:
    """(window_id, part, px1..py2): windows as parts with at most ``most`` shapes near each.

    A quadtree of each window: parts that too many shapes reach, with the halo, are
    quartered, and only their quarters are counted again. A part no wider than its
    halo, or than 2 nm, is not split on, as its quarters would see the same shapes.
    """
    todo = windows.select("window_id", F.lit(0).cast("long").alias("part"), *(F.col(f"w{c}").cast("long").alias(f"p{c}") for c in _BOX))
    done = []
    while True:
        todo = kept(todo)
        loads = bbox_join(shapes, reaching(todo, halo_nm), grid).groupBy("window_id", "part").agg(F.count(F.lit(1)).alias("_n"))
        wide = F.greatest(F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")) > max(2.0, halo_nm)
        counted = kept(todo.join(loads, ["window_id", "part"], "left").withColumn("_heavy", F.coalesce((F.col("_n") > most) & wide, F.lit(False))).drop("_n"))
        done.append(counted.where("not _heavy").drop("_heavy"))
        heavy = counted.where("_heavy")
        if heavy.isEmpty():
            break
        mid = {a: F.floor((F.col(f"p{a}1") + F.col(f"p{a}2")) / 2).cast("long") for a in "xy"}
        quarters = []
        for k in range(4):
            box = {}
            for i, a in enumerate("xy"):
                box |= {f"p{a}1": mid[a], f"p{a}2": F.col(f"p{a}2")} if (k >> i) & 1 else {f"p{a}1": F.col(f"p{a}1"), f"p{a}2": mid[a]}
            quarters.append(heavy.select("window_id", (F.col("part") * 4 + k + 1).alias("part"), *(box[f"p{c}"].alias(f"p{c}") for c in _BOX)))
        todo = quarters[0].unionByName(quarters[1]).unionByName(quarters[2]).unionByName(quarters[3]).where("px2 > px1 and py2 > py1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
