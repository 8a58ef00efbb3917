"""Queries over shapes, the cell graph, arrays and layer algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import alignment, contours, defects, hierarchy, layer_algebra, repetition, tiling
from gridloom.operators.overlap import bbox_join, normalized, touches, union_box
from gridloom.sources import oasis
from gridloom.sources.adapters import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _fields(spark: SparkSession, d: str) -> DataFrame:
    half = int(G.DEFAULT_FOV_NM / 2)
    return view(spark, d, "images").select("image_id", *((F.col(c) + s * half).alias(n) for n, c, s in (("qx1", "xrel", -1), ("qy1", "yrel", -1), ("qx2", "xrel", 1), ("qy2", "yrel", 1))))


_SEEN = "FROM images i JOIN shapes s ON s.x1 <= i.xrel + 750 AND s.x2 >= i.xrel - 750 AND s.y1 <= i.yrel + 750 AND s.y2 >= i.yrel - 750"


@query("flt_01_fov_overlap", with_views(f"SELECT image_id, layer, datatype, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 {_SEEN} GROUP BY image_id, layer, datatype", "images", "shapes"))
def _(spark, d):
    seen = bbox_join(view(spark, d, "shapes"), _fields(spark, d), 1500)
    return seen.groupBy("image_id", "layer", "datatype").agg(F.count("*").alias("n"), *union_box())


@query("flt_03_multi_layer", with_views(f"SELECT image_id, count(*) AS n {_SEEN} WHERE (layer = 10 AND datatype = 0) OR (layer = 12 AND datatype = 2) GROUP BY image_id", "images", "shapes"))
def _(spark, d):
    shapes = view(spark, d, "shapes").where("(layer = 10 and datatype = 0) or (layer = 12 and datatype = 2)")
    return bbox_join(shapes, _fields(spark, d), 1500).groupBy("image_id").agg(F.count("*").alias("n"))


@query("flt_02_box_rows", with_views("SELECT layer, datatype, x1, y1, x2, y2 FROM shapes WHERE x1 <= 60000 AND x2 >= 20000 AND y1 <= 50000 AND y2 >= 30000", "shapes"))
def _(spark, d):
    return view(spark, d, "shapes").where(touches(normalized("x1", "y1", "x2", "y2"), normalized(*map(F.lit, (60000, 50000, 20000, 30000)))))


@query("flt_05_wanted_layers", with_views("SELECT layer, datatype, count(*) AS n FROM shapes WHERE layer IN (10, 13) GROUP BY layer, datatype", "shapes"))
def _(spark, d):
    return view(spark, d, "shapes").where(F.col("layer").isin(10, 13)).groupBy("layer", "datatype").agg(F.count("*").alias("n"))


@query("flt_06_quarter_turns", "SELECT l_orderkey AS id, l_discount * 900 AS angle FROM lineitem WHERE least((l_discount * 900) % 90, 90 - (l_discount * 900) % 90) <= 0.01")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 900).alias("angle"))
    return rows.where(G.quarter_turn("angle"))


@query("flt_11_degenerate", with_views("SELECT layer, count(*) AS n FROM shapes WHERE 1 + x1 % 4 >= 3 GROUP BY layer", "shapes"))
def _(spark, d):
    """Outlines of one to four points, of which those without an area go."""
    points = F.slice(G.ring("x1", "y1", "x2", "y2"), F.lit(1), (F.col("x1") % 4 + 1).cast("int"))
    return view(spark, d, "shapes").withColumn("pts", points).where(F.size("pts") >= 3).groupBy("layer").agg(F.count("*").alias("n"))


@query("flt_04_defect_field", with_views(f"SELECT image_id, layer, count(*) AS n FROM images i JOIN shapes s ON s.x1 <= i.xrel - 350 + 750 AND s.x2 >= i.xrel - 350 - 750 AND s.y1 <= 9000 - i.yrel + 750 AND s.y2 >= 9000 - i.yrel - 750 WHERE (layer = 10 AND datatype = 0) OR (layer = 12 AND datatype = 2) GROUP BY image_id, layer", "images", "shapes"))
def _(spark, d):
    """Shapes of some layers around each defect, placed by its chip's corner, y the other way."""
    shapes = view(spark, d, "shapes").where("(layer = 10 and datatype = 0) or (layer = 12 and datatype = 2)")
    fields = alignment.fields_at(view(spark, d, "images"), 350, -9000, 1500, flip_y=True)
    return bbox_join(shapes, fields, 1500).groupBy("image_id", "layer").agg(F.count("*").alias("n"))


@query("flt_15_level_of_detail", with_views("SELECT layer, datatype, count(*) AS n FROM shapes WHERE x1 <= 80000 AND x2 >= 10000 AND y1 <= 80000 AND y2 >= 10000 AND greatest(x2 - x1, y2 - y1) >= 0.7 / 0.005 GROUP BY layer, datatype", "shapes"))
def _(spark, d):
    box = normalized("x1", "y1", "x2", "y2")
    seen = touches(box, [F.lit(v) for v in (10000, 10000, 80000, 80000)]) & (F.greatest(box[2] - box[0], box[3] - box[1]) >= 0.7 / 0.005)
    return view(spark, d, "shapes").where(seen).groupBy("layer", "datatype").agg(F.count("*").alias("n"))


@query("prj_12_ring_box", with_views("SELECT layer, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y1) AS BIGINT) AS y1, CAST(sum(x2) AS BIGINT) AS x2, CAST(sum(y2) AS BIGINT) AS y2 FROM shapes GROUP BY layer", "shapes"))
def _(spark, d):
    boxes = view(spark, d, "shapes").withColumn("pts", G.ring("x1", "y1", "x2", "y2")).select("layer", *(c.alias(n) for c, n in zip(G.ring_box(F.col("pts")), ("x1", "y1", "x2", "y2"), strict=True)))
    return boxes.groupBy("layer").agg(*(F.sum(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("agg_01_union_bbox", with_views("SELECT layer, datatype, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM shapes GROUP BY layer, datatype", "shapes"))
def _(spark, d):
    return view(spark, d, "shapes").groupBy("layer", "datatype").agg(*union_box())


@query("agg_05_layer_counts", with_views("SELECT layer, count(*) AS n, count(*) FILTER (x2 - x1 = y2 - y1) AS squares, count(DISTINCT datatype) AS datatypes FROM shapes GROUP BY layer", "shapes"))
def _(spark, d):
    return view(spark, d, "shapes").groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("x2") - F.col("x1") == F.col("y2") - F.col("y1")).alias("squares"), F.countDistinct("datatype").alias("datatypes"))


@query("agg_06_summary", with_views("SELECT count(*) AS n_rects, count(DISTINCT cell_id) AS n_cells, (SELECT count(*) FROM placement) AS n_placements, (SELECT count(DISTINCT parent) FROM placement) AS n_parents FROM cell_rect", "cell_rect", "placement"))
def _(spark, d):
    rects = view(spark, d, "cell_rect").agg(F.count("*").alias("n_rects"), F.countDistinct("cell_id").alias("n_cells"))
    placed = view(spark, d, "placement").agg(F.count("*").alias("n_placements"), F.countDistinct("parent").alias("n_parents"))
    return rects.join(F.broadcast(placed))


@query("src_07_layers", with_views("SELECT DISTINCT layer, datatype FROM shapes", "shapes"))
def _(spark, d):
    return view(spark, d, "shapes").select("layer", "datatype").distinct()


_TURN = {"a": "CASE {q} WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", "c": "CASE {q} WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END"}
_EDGES = f"""edge AS (SELECT parent, child, x, y, {_TURN['a'].format(q='q')} AS ea, -({_TURN['c'].format(q='q')}) * (CASE WHEN flip THEN -1 ELSE 1 END) AS eb,
  {_TURN['c'].format(q='q')} AS ec, {_TURN['a'].format(q='q')} * (CASE WHEN flip THEN -1 ELSE 1 END) AS ed FROM placement)"""
_WALK = f"""{_EDGES}, walk AS (SELECT CAST(0 AS BIGINT) AS cell_id, 1 AS a, 0 AS b, 0 AS c, 1 AS d, CAST(0 AS BIGINT) AS tx, CAST(0 AS BIGINT) AS ty
  UNION ALL SELECT child, a * ea + b * ec, a * eb + b * ed, c * ea + d * ec, c * eb + d * ed, a * x + b * y + tx, c * x + d * y + ty FROM walk JOIN edge ON cell_id = parent)"""
_FLAT = f"""+{_WALK}, flat AS (SELECT w.cell_id, least(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx AS x1, least(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty AS y1,
  greatest(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx AS x2, greatest(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty AS y2 FROM walk w JOIN cell_rect r ON w.cell_id = r.cell_id)"""
_ROI = (900000, -200000, 1250000, 150000)


@query("wlk_01_flatten", with_views(f"{_FLAT} SELECT cell_id, count(*) AS n, CAST(sum(x1) AS BIGINT) AS sx, CAST(sum(y1) AS BIGINT) AS sy, min(x1) AS x1, max(y2) AS y2, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM flat GROUP BY cell_id", "placement", "cell_rect", recursive=True))
def _(spark, d):
    flat = hierarchy.flattened(hierarchy.instances(view(spark, d, "placement"), 0), view(spark, d, "cell_rect"))
    return flat.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("x1").alias("sx"), F.sum("y1").alias("sy"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


@query("wlk_03_roi", with_views(f"{_FLAT} SELECT cell_id, x1, y1, x2, y2 FROM flat WHERE x1 <= {_ROI[2]} AND x2 >= {_ROI[0]} AND y1 <= {_ROI[3]} AND y2 >= {_ROI[1]}", "placement", "cell_rect", recursive=True))
def _(spark, d):
    placement, rects = view(spark, d, "placement"), view(spark, d, "cell_rect")
    placed = hierarchy.instances(placement, 0, hierarchy.subtree_bounds(placement, rects), _ROI)
    return hierarchy.flattened(placed, rects, _ROI).select("cell_id", "x1", "y1", "x2", "y2")


@query("wlk_06_instances", with_views(f"+{_WALK} SELECT cell_id, a, b, c, d, tx, ty FROM walk", "placement", recursive=True))
def _(spark, d):
    return hierarchy.instances(view(spark, d, "placement"), 0)


@query("agg_03_reachable_bbox", with_views(f"""+{_EDGES}, up AS (SELECT cell_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM cell_rect GROUP BY cell_id
  UNION ALL SELECT parent, least(ea * x1 + eb * y1, ea * x2 + eb * y2, ea * x1 + eb * y2, ea * x2 + eb * y1) + x, least(ec * x1 + ed * y1, ec * x2 + ed * y2, ec * x1 + ed * y2, ec * x2 + ed * y1) + y,
  greatest(ea * x1 + eb * y1, ea * x2 + eb * y2, ea * x1 + eb * y2, ea * x2 + eb * y1) + x, greatest(ec * x1 + ed * y1, ec * x2 + ed * y2, ec * x1 + ed * y2, ec * x2 + ed * y1) + y FROM up JOIN edge ON up.cell_id = child)
  SELECT cell_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM up GROUP BY cell_id""", "placement", "cell_rect", recursive=True))
def _(spark, d):
    return hierarchy.subtree_bounds(view(spark, d, "placement"), view(spark, d, "cell_rect"))


@query("srt_07_root_cell", with_views("+cells AS (SELECT parent AS cell_id FROM placement UNION SELECT child FROM placement UNION SELECT cell_id FROM cell_rect), k AS (SELECT cell_id, CASE WHEN cell_id NOT IN (SELECT child FROM placement) THEN 1 ELSE 0 END AS free, (SELECT count(*) FROM placement p WHERE p.parent = cells.cell_id) AS n_placed, (SELECT count(*) FROM cell_rect r WHERE r.cell_id = cells.cell_id) AS n_rects FROM cells) SELECT cell_id, n_placed, n_rects FROM k ORDER BY free DESC, n_placed DESC, n_rects DESC, cell_id DESC LIMIT 1", "placement", "cell_rect"))
def _(spark, d):
    return hierarchy.root_cell(view(spark, d, "placement"), view(spark, d, "cell_rect"))


@query("srt_04_levels", with_views("+deep AS (SELECT CAST(0 AS BIGINT) AS cell_id, 0 AS level UNION SELECT child, level + 1 FROM deep JOIN placement ON cell_id = parent) SELECT cell_id, max(level) AS level FROM deep GROUP BY cell_id", "placement", recursive=True))
def _(spark, d):
    return hierarchy.levels(view(spark, d, "placement"), 0)


@query("jon_01_unknown_targets", with_views("SELECT child, count(*) AS n FROM placement WHERE child NOT IN (SELECT cell_id FROM cell_rect WHERE datatype = 0 AND layer = 10) AND child NOT IN (SELECT parent FROM placement) GROUP BY child", "placement", "cell_rect"))
def _(spark, d):
    """Cells are known by their shapes on one layer, so that some targets are not."""
    return hierarchy.unknown_targets(view(spark, d, "placement"), view(spark, d, "cell_rect").where("datatype = 0 and layer = 10"))


@query("wlk_11_region_layers", with_views(f"{_FLAT.replace('SELECT w.cell_id,', 'SELECT w.cell_id, layer, datatype,')} SELECT layer, datatype, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM flat WHERE x1 <= {_ROI[2]} AND x2 >= {_ROI[0]} AND y1 <= {_ROI[3]} AND y2 >= {_ROI[1]} GROUP BY layer, datatype", "placement", "cell_rect", recursive=True))
def _(spark, d):
    placement, rects = view(spark, d, "placement"), view(spark, d, "cell_rect")
    placed = hierarchy.instances(placement, 0, hierarchy.subtree_bounds(placement, rects), _ROI)
    return hierarchy.region_layers(hierarchy.flattened(placed, rects, _ROI))


_ALL = "+e AS (SELECT a.*, i, j, i * vx + j * wx AS dx, i * vy + j * wy AS dy FROM (SELECT *, unnest(range(nx)) AS i FROM arrays) a, LATERAL (SELECT unnest(range(ny)) AS j))"


@query("rep_02_expand", with_views(f"{_ALL} SELECT rep_id, count(*) AS n, CAST(sum(dx) AS BIGINT) AS sx, CAST(sum(dy) AS BIGINT) AS sy, max(dx * 1000 + dy) AS far FROM e GROUP BY rep_id", "arrays"))
def _(spark, d):
    return repetition.expand(view(spark, d, "arrays")).groupBy("rep_id").agg(F.count("*").alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"), F.max(F.col("dx") * 1000 + F.col("dy")).alias("far"))


@query("rep_03_extent", with_views(f"{_ALL} SELECT rep_id, min(dx) AS x1, min(dy) AS y1, max(dx) AS x2, max(dy) AS y2, count(*) AS n FROM e GROUP BY rep_id", "arrays"))
def _(spark, d):
    return view(spark, d, "arrays").select("rep_id", *(c.alias(n) for c, n in zip(repetition.extent(), ("x1", "y1", "x2", "y2"), strict=True)), repetition.count().alias("n"))


@query("rep_09_clip", with_views(f"{_ALL} SELECT rep_id, i, j FROM e WHERE x1 + dx <= qx1 + 80 AND x2 + dx >= qx1 AND y1 + dy <= qy1 + 80 AND y2 + dy >= qy1", "arrays"))
def _(spark, d):
    return repetition.clipped(view(spark, d, "arrays"), 80).select("rep_id", "i", "j")


@query("rep_10_plan", with_views("SELECT CASE WHEN vy = 0 AND wx = 0 THEN 'grid' WHEN nx * ny <= 20 THEN 'expand' ELSE 'bail' END AS kind, count(*) AS n FROM arrays GROUP BY 1", "arrays"))
def _(spark, d):
    return view(spark, d, "arrays").groupBy(repetition.plan_kind(20).alias("kind")).agg(F.count("*").alias("n"))


#: The layers that formulas refer to.
LAYERS = {"A": (10, 0), "B": (11, 1), "C": (12, 2)}
_TILES = """bounds AS (SELECT min(x1) AS cx1, min(y1) AS cy1, max(x2) AS cx2, max(y2) AS cy2 FROM shapes),
  grid AS (SELECT *, least(64, greatest(1, CAST(ceil((cx2 - cx1) / 1500e0) AS BIGINT))) AS nx, least(64, greatest(1, CAST(ceil((cy2 - cy1) / 1500e0) AS BIGINT))) AS ny FROM bounds),
  tiles AS (SELECT j * nx + i AS window_id, cx1 + CAST(floor(i * (CAST(cx2 - cx1 AS DOUBLE) / nx)) AS BIGINT) AS wx1, cy1 + CAST(floor(j * (CAST(cy2 - cy1 AS DOUBLE) / ny)) AS BIGINT) AS wy1,
  CASE WHEN i = nx - 1 THEN cx2 ELSE cx1 + CAST(floor((i + 1) * (CAST(cx2 - cx1 AS DOUBLE) / nx)) AS BIGINT) END AS wx2, CASE WHEN j = ny - 1 THEN cy2 ELSE cy1 + CAST(floor((j + 1) * (CAST(cy2 - cy1 AS DOUBLE) / ny)) AS BIGINT) END AS wy2
  FROM grid, (SELECT range AS i FROM range(64)), (SELECT range AS j FROM range(64)) WHERE i < nx AND j < ny)"""


def _area_sql(rule: str, grow: int = 0) -> str:
    """Area by tile where the rule of a, b, c holds; A may be grown along x."""
    return with_views(
        f"""+{_TILES}, op AS (SELECT CASE layer WHEN 10 THEN 'A' WHEN 11 THEN 'B' ELSE 'C' END AS ref, x1 - CASE layer WHEN 10 THEN {grow} ELSE 0 END AS x1, y1, x2 + CASE layer WHEN 10 THEN {grow} ELSE 0 END AS x2, y2
    FROM shapes WHERE (layer = 10 AND datatype = 0) OR (layer = 11 AND datatype = 1) OR (layer = 12 AND datatype = 2)),
  cl AS (SELECT window_id, ref, greatest(x1, wx1) AS x1, greatest(y1, wy1) AS y1, least(x2, wx2) AS x2, least(y2, wy2) AS y2 FROM tiles JOIN op ON x1 < wx2 AND x2 > wx1 AND y1 < wy2 AND y2 > wy1),
  ex AS (SELECT window_id, x AS a, lead(x) OVER (PARTITION BY window_id ORDER BY x) AS b FROM (SELECT window_id, x1 AS x FROM cl UNION SELECT window_id, x2 FROM cl UNION SELECT window_id, wx1 FROM tiles UNION SELECT window_id, wx2 FROM tiles)),
  ey AS (SELECT window_id, y AS a, lead(y) OVER (PARTITION BY window_id ORDER BY y) AS b FROM (SELECT window_id, y1 AS y FROM cl UNION SELECT window_id, y2 FROM cl UNION SELECT window_id, wy1 FROM tiles UNION SELECT window_id, wy2 FROM tiles)),
  cell AS (SELECT ex.window_id, ex.a AS x1, ex.b AS x2, ey.a AS y1, ey.b AS y2, coalesce(bool_or(ref = 'A'), false) AS a, coalesce(bool_or(ref = 'B'), false) AS b, coalesce(bool_or(ref = 'C'), false) AS c
    FROM ex JOIN ey ON ex.window_id = ey.window_id LEFT JOIN cl ON cl.window_id = ex.window_id AND cl.x1 <= ex.a AND cl.x2 >= ex.b AND cl.y1 <= ey.a AND cl.y2 >= ey.b
    WHERE ex.b IS NOT NULL AND ey.b IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
  SELECT window_id, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM cell WHERE {rule} GROUP BY window_id""",
        "shapes",
    )


def _areas(spark: SparkSession, d: str, formula: str, recipes: dict[str, str] | None = None) -> DataFrame:
    shapes = view(spark, d, "shapes")
    tiles = tiling.tile_grid(spark, tiling.box_of(shapes), 1500)
    found = layer_algebra.apply(formula, LAYERS, shapes, tiles, recipes=recipes)
    return found.groupBy("window_id").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long").alias("area"))


for _name, _formula, _rule, _grow in (
    ("set_01_and", "A & B", "a AND b", 0),
    ("set_02_or", "A | B", "a OR b", 0),
    ("set_03_minus", "A - B", "a AND NOT b", 0),
    ("set_04_not", "~A", "NOT a", 0),
    ("set_05_grow", "A > W:30", "a", 30),
    ("exp_06_formula", "[(A > W:25) & ~B] | C", "(a AND NOT b) OR c", 25),
):
    query(_name, _area_sql(_rule, _grow))(lambda spark, d, f=_formula: _areas(spark, d, f))


@query("exp_05_recipe", _area_sql("(a OR b) AND NOT c", 40))
def _(spark, d):
    return _areas(spark, d, "R2 - C", {"R1": "A > W:40", "R2": "R1 | B"})


_SHRUNK = f"""+{_TILES}, sh AS (SELECT window_id, greatest(x1, wx1) AS x1, least(x2, wx2) AS x2, y1, y2, wy1, wy2 FROM tiles JOIN shapes ON x1 < wx2 AND x2 > wx1 AND y1 < wy2 + 5 AND y2 > wy1 - 5
    WHERE (layer = 10 AND datatype = 0) OR (layer = 11 AND datatype = 1) OR (layer = 12 AND datatype = 2)),
  ex AS (SELECT window_id, x AS a, lead(x) OVER (PARTITION BY window_id ORDER BY x) AS b FROM (SELECT window_id, x1 AS x FROM sh UNION SELECT window_id, x2 FROM sh)),
  seg AS (SELECT ex.window_id, a, b, y1, y2, wy1, wy2 FROM ex JOIN sh ON sh.window_id = ex.window_id AND sh.x1 <= a AND sh.x2 >= b WHERE b IS NOT NULL),
  mark AS (SELECT *, CASE WHEN y1 <= max(y2) OVER (PARTITION BY window_id, a ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM seg),
  isl AS (SELECT *, sum(fresh) OVER (PARTITION BY window_id, a ORDER BY y1, y2 ROWS UNBOUNDED PRECEDING) AS g FROM mark),
  run AS (SELECT window_id, a, b, g, min(y1) AS y1, max(y2) AS y2, min(wy1) AS wy1, min(wy2) AS wy2 FROM isl GROUP BY window_id, a, b, g)
  SELECT window_id, CAST(sum((b - a) * greatest(0, least(y2 - 5, wy2) - greatest(y1 + 5, wy1))) AS BIGINT) AS area FROM run GROUP BY window_id HAVING area > 0"""


@query("set_06_shrink", with_views(_SHRUNK, "shapes"))
def _(spark, d):
    return _areas(spark, d, "(A | B | C) < H:5")


@query("til_01_grid", with_views(f"+{_TILES}, c AS (SELECT window_id, count(*) AS n FROM tiles JOIN shapes ON x1 < wx2 AND x2 > wx1 AND y1 < wy2 AND y2 > wy1 GROUP BY window_id) SELECT tiles.window_id, wx1, wy1, wx2, wy2, coalesce(n, 0) AS n FROM tiles LEFT JOIN c ON tiles.window_id = c.window_id", "shapes"))
def _(spark, d):
    """The tiles of the box around all shapes, and how many shapes reach into each."""
    shapes = view(spark, d, "shapes")
    tiles = tiling.tile_grid(spark, tiling.box_of(shapes), 1500)
    held = tiling.clip_to_tiles(shapes, tiles, 2000).groupBy("window_id").agg(F.count("*").alias("n"))
    return tiles.join(held, "window_id", "left").na.fill(0, ["n"])


@query("til_02_clip", with_views(f"+{_TILES}, cl AS (SELECT window_id, layer, greatest(x1, wx1) AS x1, greatest(y1, wy1) AS y1, least(x2, wx2) AS x2, least(y2, wy2) AS y2 FROM tiles JOIN shapes ON x1 < wx2 AND x2 > wx1 AND y1 < wy2 AND y2 > wy1) SELECT window_id, layer, count(*) AS n, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM cl GROUP BY window_id, layer", "shapes"))
def _(spark, d):
    shapes = view(spark, d, "shapes")
    cut = tiling.clip_to_tiles(shapes, tiling.tile_grid(spark, tiling.box_of(shapes), 1500), 2000)
    return cut.groupBy("window_id", "layer").agg(F.count("*").alias("n"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


_PIXELS = """+near AS (SELECT image_id, layer, x1 - xrel + 750 AS x1, y1 - yrel + 750 AS y1, x2 - xrel + 750 AS x2, y2 - yrel + 750 AS y2 FROM images i JOIN shapes s ON s.x1 <= xrel + 750 AND s.x2 >= xrel - 750 AND s.y1 <= yrel + 750 AND s.y2 >= yrel - 750),
  px AS (SELECT image_id, layer, greatest(CAST(round_even(x1 / 25e0, 0) AS BIGINT), 0) AS c1, least(CAST(round_even(x2 / 25e0, 0) AS BIGINT), 59) AS c2,
    greatest(59 - CAST(round_even(y2 / 25e0, 0) AS BIGINT), 0) AS r1, least(59 - CAST(round_even(y1 / 25e0, 0) AS BIGINT), 59) AS r2 FROM near),
  cells AS (SELECT image_id, layer, c, unnest(range(r1, r2 + 1)) AS r FROM (SELECT *, unnest(range(c1, c2 + 1)) AS c FROM px)),
  top AS (SELECT image_id, c, r, max(layer) AS layer FROM cells GROUP BY image_id, c, r)
  SELECT image_id, CAST(layer AS INTEGER) AS layer, count(*) AS n_pixels FROM top GROUP BY image_id, layer"""


@query("prd_01_label_pixels", with_views(_PIXELS, "images", "shapes"))
def _(spark, d):
    images = view(spark, d, "images").select("image_id", F.col("xrel").alias("cx"), F.col("yrel").alias("cy"))
    return alignment.label_counts(alignment.in_view(view(spark, d, "shapes"), images, 1500), 1500, 60)


_FORMULA_PIXELS = """+near AS (SELECT image_id, layer, x1 - xrel + 750 AS x1, y1 - yrel + 750 AS y1, x2 - xrel + 750 AS x2, y2 - yrel + 750 AS y2
    FROM images i JOIN shapes s ON s.x1 <= xrel + 800 AND s.x2 >= xrel - 800 AND s.y1 <= yrel + 800 AND s.y2 >= yrel - 800
    WHERE (layer = 10 AND datatype = 0) OR (layer = 11 AND datatype = 1) OR (layer = 12 AND datatype = 2)),
  px AS (SELECT image_id, layer, CAST(round_even(x1 / 25e0, 0) AS BIGINT) AS c1, CAST(round_even(x2 / 25e0, 0) AS BIGINT) AS c2, 59 - CAST(round_even(y2 / 25e0, 0) AS BIGINT) AS r1, 59 - CAST(round_even(y1 / 25e0, 0) AS BIGINT) AS r2 FROM near),
  ends AS (SELECT image_id, layer, greatest(c1, 0) AS c1, least(c2, 59) AS c2, greatest(r1, 0) AS r1, least(r2, 59) AS r2 FROM px
    UNION ALL SELECT image_id, 0, greatest(greatest(c1, -2) - 2, 0), least(least(c2, 61) + 2, 59), greatest(r1, 0), least(r2, 59) FROM px WHERE layer = 10 AND c1 <= 61 AND c2 >= -2),
  cells AS (SELECT image_id, layer, c, unnest(range(r1, r2 + 1)) AS r FROM (SELECT *, unnest(range(c1, c2 + 1)) AS c FROM ends)),
  flags AS (SELECT image_id, c, r, bool_or(layer = 0) AS g, bool_or(layer = 10) AS a, bool_or(layer = 11) AS b, bool_or(layer = 12) AS c3 FROM cells GROUP BY image_id, c, r),
  n AS (SELECT image_id, count(*) AS n FROM flags WHERE (g AND b) OR (c3 AND NOT a) GROUP BY image_id)
  SELECT images.image_id, coalesce(n, 0) AS n_pixels FROM images LEFT JOIN n ON n.image_id = images.image_id"""


@query("exp_07_pixel_formula", with_views(_FORMULA_PIXELS, "images", "shapes"))
def _(spark, d):
    """A layer formula worked out on the pixels of every image's field."""
    images = view(spark, d, "images").select("image_id", F.col("xrel").alias("cx"), F.col("yrel").alias("cy"))
    return alignment.formula_pixels(images, view(spark, d, "shapes"), "((A > W:50) & B) | (C - A)", LAYERS, 1500, 60)


@query("aln_03_match")
def _(spark, d):
    """Each image drawn with the offset of its stored result, and matched back.

    Some images have no coordinates, no file or no scale, and some no shape of
    the layers that the template shows.
    """
    drift = view(spark, d, "refined").select("image_id", (F.col("dx_nm") * 12).alias("ox"), (F.col("dy_nm") * 12).alias("oy"))
    images = view(spark, d, "images").select("image_id", "has_coords", F.col("xrel").alias("cx"), F.col("yrel").alias("cy"), (F.col("width_px") % 17 != 0).alias("has_file"), F.when(F.col("width_px") % 19 != 0, 25.0).otherwise(0.0).alias("nm_per_px"))
    return alignment.matched(images.join(drift, "image_id"), view(spark, d, "shapes"), {10: 90, 11: 140, 12: 200, 13: 255}, 1500, 60, 12)


@query("aln_04_states", with_views("SELECT CASE WHEN NOT has_coords THEN 'no-coords' WHEN width_px % 17 = 0 THEN 'missing-file' WHEN width_px % 19 = 0 THEN 'no-scale' ELSE 'tried' END AS state, count(*) AS n FROM images GROUP BY 1", "images"))
def _(spark, d):
    images = view(spark, d, "images").select("has_coords", (F.col("width_px") % 17 != 0).alias("has_file"), F.when(F.col("width_px") % 19 != 0, 25.0).otherwise(0.0).alias("nm_per_px"))
    return images.groupBy(F.coalesce(alignment.state(), F.lit("tried")).alias("state")).agg(F.count("*").alias("n"))


@query("prd_06_lowest_corner", with_views("SELECT image_id, xrel - width_px / 2e0 * 4e0 AS x_nm, yrel - (width_px / 2e0 - 1) * 4e0 AS y_nm FROM images", "images"))
def _(spark, d):
    x, y = alignment.lowest_corner("xrel", "yrel", "width_px", "width_px", "scale")
    return view(spark, d, "images").withColumn("scale", F.lit(4.0)).select("image_id", x.alias("x_nm"), y.alias("y_nm"))


@query("agg_15_point_types", with_views("SELECT CAST(x1 % 6 AS INTEGER) AS point_type, count(*) AS n, round(count(*) FILTER (x1 % 6 <= 1) * 1e2 / sum(count(*)) OVER (), 6) AS rectilinear_pct FROM shapes GROUP BY 1", "shapes"))
def _(spark, d):
    return layer_algebra.point_types(view(spark, d, "shapes").withColumn("point_type", (F.col("x1") % 6).cast("int")))


@query("rep_02_lists", with_views("""+g AS (SELECT rep_id, rep_id % 6 AS k, 1 + nx % 4 AS grid, [nx, ny, vx] AS dx, [wy, nx, ny] AS dy FROM arrays),
  s AS (SELECT rep_id, CASE k WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 7 WHEN 4 THEN 10 ELSE 11 END AS rtype, CASE WHEN k IN (1, 3, 5) THEN grid ELSE 1 END AS f, dx, dy, unnest(range(4)) AS step FROM g)
  SELECT rep_id, step, CASE WHEN rtype IN (6, 7) THEN 0 ELSE f * coalesce(list_sum(dx[1:step]), 0) END AS dx, CASE WHEN rtype IN (4, 5) THEN 0 WHEN rtype IN (6, 7) THEN f * coalesce(list_sum(dx[1:step]), 0) ELSE f * coalesce(list_sum(dy[1:step]), 0) END AS dy FROM s""", "arrays"))
def _(spark, d):
    """Repetitions by lists of gaps along x or y, or of offsets, with and without a grid."""
    kind = F.element_at(F.array(*map(F.lit, (4, 5, 6, 7, 10, 11))), (F.col("rep_id") % 6 + 1).cast("int"))
    rows = view(spark, d, "arrays").select("rep_id", kind.alias("rtype"), (1 + F.col("nx") % 4).alias("grid"), F.array("nx", "ny", "vx").alias("gaps_x"), F.array("wy", "nx", "ny").alias("gaps_y"))
    return repetition.expand_lists(rows).select("rep_id", F.col("step").cast("long").alias("step"), "dx", "dy")


@query("exp_13_all_recipes", _area_sql("a AND b").replace("SELECT window_id, CAST(sum", "SELECT 'good' AS recipe, window_id, CAST(sum") + " UNION ALL SELECT 'broken', -1, 0 UNION ALL SELECT 'loop', -1, 0")
def _(spark, d):
    """All recipes at once; one that cannot be worked out is reported and stops no other."""
    shapes = view(spark, d, "shapes")
    tiles = tiling.tile_grid(spark, tiling.box_of(shapes), 1500)
    found, errors = layer_algebra.apply_all({"good": "A & B", "broken": "A & (B", "loop": "loop | A"}, LAYERS, shapes, tiles)
    areas = found.groupBy("recipe", "window_id").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long").alias("area"))
    return areas.unionByName(errors.select("recipe", F.lit(-1).cast("long").alias("window_id"), F.lit(0).cast("long").alias("area")))


@query("oasis_roundtrip", with_views("SELECT 'tile' || CAST(x1 // 5000 * 100 + y1 // 5000 AS VARCHAR) AS path, layer, datatype, x1, y1, x2, y2 FROM shapes", "shapes"))
def _(spark, d):
    """Shapes written as layout files, one for each 5 um square, and read back."""
    square = F.floor(F.col("x1") / 5000) * 100 + F.floor(F.col("y1") / 5000)
    files = oasis.write(view(spark, d, "shapes").withColumn("path", F.concat(F.lit("tile"), square.cast("string"))))
    return oasis.read(files).select("path", "layer", "datatype", "x1", "y1", "x2", "y2")


@query("agg_04_record_histogram", with_views("SELECT 'rect' AS kind, layer, count(*) AS n FROM shapes GROUP BY layer", "shapes"))
def _(spark, d):
    square = F.floor(F.col("x1") / 5000) * 100 + F.floor(F.col("y1") / 5000)
    files = oasis.write(view(spark, d, "shapes").withColumn("path", F.concat(F.lit("tile"), square.cast("string"))))
    return oasis.read(files).groupBy("kind", "layer").agg(F.count("*").alias("n"))


@query("agg_02_array_box", with_views("SELECT rep_id, x1 + least(0, (nx - 1) * vx, (ny - 1) * wx, (nx - 1) * vx + (ny - 1) * wx) AS x1, y2 + greatest(0, (nx - 1) * vy, (ny - 1) * wy, (nx - 1) * vy + (ny - 1) * wy) AS y2 FROM arrays", "arrays"))
def _(spark, d):
    low_x, _, _, high_y = repetition.extent()
    return view(spark, d, "arrays").select("rep_id", (F.col("x1") + low_x).alias("x1"), (F.col("y2") + high_y).alias("y2"))


@query("agg_10_walk_counters", with_views(f"+{_WALK} SELECT count(*) AS visited, count(DISTINCT cell_id) AS cells, CAST(sum(CASE WHEN cell_id IN (SELECT cell_id FROM cell_rect) THEN 1 ELSE 0 END) AS BIGINT) AS with_shapes FROM walk", "placement", "cell_rect", recursive=True))
def _(spark, d):
    placed = hierarchy.instances(view(spark, d, "placement"), 0)
    marked = placed.join(view(spark, d, "cell_rect").select("cell_id").distinct().withColumn("has", F.lit(1)), "cell_id", "left")
    return marked.agg(F.count("*").alias("visited"), F.countDistinct("cell_id").alias("cells"), F.sum(F.coalesce("has", F.lit(0))).alias("with_shapes"))


@query("srt_10_first_shapes", with_views("SELECT layer, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY x1, y1, x2, y2, datatype) AS k FROM shapes) WHERE k <= 1000", "shapes"))
def _(spark, d):
    return defects.first_rows(view(spark, d, "shapes"), "layer", ["x1", "y1", "x2", "y2", "datatype"], 1000).select("layer", "x1", "y1", "x2", "y2")


@query("win_08_running_offsets", with_views("SELECT rep_id, 0 AS o0, nx AS o1, nx + ny AS o2, nx + ny + vx AS o3 FROM arrays", "arrays"))
def _(spark, d):
    offsets = view(spark, d, "arrays").select("rep_id", repetition.running(F.array("nx", "ny", "vx")).alias("o"))
    return offsets.select("rep_id", *(F.get("o", F.lit(k)).alias(f"o{k}") for k in range(4)))


@query("wlk_02_polygons", with_views(f"{_FLAT} SELECT cell_id, count(*) AS n, CAST(sum(2 * (x1 + x2)) AS BIGINT) AS sx, CAST(sum(2 * (y1 + y2)) AS BIGINT) AS sy, min(x1) AS x1, max(y2) AS y2 FROM flat GROUP BY cell_id", "placement", "cell_rect", recursive=True))
def _(spark, d):
    rings = view(spark, d, "cell_rect").select("cell_id", G.ring("x1", "y1", "x2", "y2").alias("pts"))
    flat = hierarchy.flattened_polygons(hierarchy.instances(view(spark, d, "placement"), 0), rings)
    total = lambda a: F.aggregate("pts", F.lit(0).cast("long"), lambda acc, p: acc + p[a])
    box = G.ring_box(F.col("pts"))
    return flat.select("cell_id", total("x").alias("sx"), total("y").alias("sy"), box[0].alias("x1"), box[3].alias("y2")).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.min("x1").alias("x1"), F.max("y2").alias("y2"))


_EACH = _EDGES.replace("AS (SELECT parent, child, x, y,", "AS (SELECT parent, child, x + i * vx + j * wx AS x, y + i * vy + j * wy AS y, nx * ny AS n_all,").replace(
    "FROM placement)", "FROM (SELECT *, unnest(range(nx)) AS i FROM placement_arrays), LATERAL (SELECT unnest(range(ny)) AS j))"
)
_UP = """up AS (SELECT cell_id, min(x1) AS x1, min(y1) AS y1, max(x2 + (nx - 1) * vx) AS x2, max(y2 + (nx - 1) * vy + (ny - 1) * wy) AS y2 FROM rect_arrays GROUP BY cell_id
  UNION ALL SELECT parent, min(least(ea * x1 + eb * y1, ea * x2 + eb * y2, ea * x1 + eb * y2, ea * x2 + eb * y1) + x), min(least(ec * x1 + ed * y1, ec * x2 + ed * y2, ec * x1 + ed * y2, ec * x2 + ed * y1) + y),
  max(greatest(ea * x1 + eb * y1, ea * x2 + eb * y2, ea * x1 + eb * y2, ea * x2 + eb * y1) + x), max(greatest(ec * x1 + ed * y1, ec * x2 + ed * y2, ec * x1 + ed * y2, ec * x2 + ed * y1) + y) FROM up JOIN edge ON up.cell_id = child GROUP BY parent),
  bound AS (SELECT cell_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM up GROUP BY cell_id)"""
_STEP = """SELECT level + 1 AS level, child AS cell_id, a * ea + b * ec AS a, a * eb + b * ed AS b, c * ea + d * ec AS c, c * eb + d * ed AS d, a * x + b * y + tx AS tx, c * x + d * y + ty AS ty FROM walk JOIN edge ON cell_id = parent"""
_ARRAY_WALK = f"""{_EACH}, {_UP}, walk AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS cell_id, 1 AS a, 0 AS b, 0 AS c, 1 AS d, CAST(0 AS BIGINT) AS tx, CAST(0 AS BIGINT) AS ty
  UNION ALL SELECT s.* FROM ({_STEP}) s JOIN bound k ON s.cell_id = k.cell_id
    WHERE least(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx <= {_ROI[2]} AND greatest(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx >= {_ROI[0]}
      AND least(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty <= {_ROI[3]} AND greatest(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty >= {_ROI[1]})"""
_RECTS = "r AS (SELECT cell_id, layer, datatype, x1 + i * vx + j * wx AS x1, y1 + i * vy + j * wy AS y1, x2 + i * vx + j * wx AS x2, y2 + i * vy + j * wy AS y2 FROM (SELECT *, unnest(range(nx)) AS i FROM rect_arrays), LATERAL (SELECT unnest(range(ny)) AS j))"


def _array_walk(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], DataFrame]:
    placement, rects = view(spark, d, "placement_arrays"), view(spark, d, "rect_arrays")
    low_x, low_y, high_x, high_y = repetition.extent()
    boxes = rects.select("cell_id", (F.col("x1") + low_x).alias("x1"), (F.col("y1") + low_y).alias("y1"), (F.col("x2") + high_x).alias("x2"), (F.col("y2") + high_y).alias("y2"))
    bounds = hierarchy.subtree_bounds(hierarchy.corners(placement), boxes)
    return *hierarchy.walk_arrays(placement, 0, bounds, _ROI), rects


@query("wlk_12_arrays", with_views(f"+{_ARRAY_WALK}, {_RECTS}, flat AS (SELECT w.cell_id, layer, datatype, least(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx AS x1, least(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty AS y1, greatest(a * x1 + b * y1, a * x2 + b * y2, a * x1 + b * y2, a * x2 + b * y1) + tx AS x2, greatest(c * x1 + d * y1, c * x2 + d * y2, c * x1 + d * y2, c * x2 + d * y1) + ty AS y2 FROM walk w JOIN r ON w.cell_id = r.cell_id) SELECT cell_id, layer, datatype, x1, y1, x2, y2 FROM flat WHERE x1 <= {_ROI[2]} AND x2 >= {_ROI[0]} AND y1 <= {_ROI[3]} AND y2 >= {_ROI[1]}", "placement_arrays", "rect_arrays", recursive=True))
def _(spark, d):
    """Shapes of a region, from placements and shapes that are arrays, of which only elements in the region are made."""
    placed, _, rects = _array_walk(spark, d)
    return hierarchy.flattened_arrays(placed, rects, _ROI).select("cell_id", "layer", "datatype", "x1", "y1", "x2", "y2")


@query("agg_10_array_counters", with_views(f"+{_ARRAY_WALK}, met AS (SELECT level + 1 AS level, count(*) AS placements, CAST(sum(nx * ny) AS BIGINT) AS elements, max(nx * ny) AS largest FROM walk JOIN placement_arrays ON cell_id = parent GROUP BY level), got AS (SELECT level, count(*) AS n FROM walk GROUP BY level) SELECT met.level, placements, elements, largest, CAST(0 AS BIGINT) AS skipped, coalesce(n, 0) AS kept, elements - coalesce(n, 0) AS pruned FROM met LEFT JOIN got ON met.level = got.level", "placement_arrays", "rect_arrays", recursive=True))
def _(spark, d):
    """What a walk of arrays meets, makes and leaves out, level by level."""
    _, counters, _ = _array_walk(spark, d)
    return spark.createDataFrame([tuple(c[k] for k in ("level", "placements", "elements", "largest", "skipped", "kept", "pruned")) for c in counters], "level int, placements long, elements long, largest long, skipped long, kept long, pruned long")


@query("wlk_13_instance_counts", with_views("+n AS (SELECT CAST(0 AS BIGINT) AS cell_id, CAST(1 AS BIGINT) AS n UNION ALL SELECT child, n * nx * ny FROM n JOIN placement_arrays ON cell_id = parent) SELECT cell_id, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY cell_id", "placement_arrays", recursive=True))
def _(spark, d):
    return hierarchy.instance_counts(view(spark, d, "placement_arrays"), 0)


def _ring_sql(rule: str) -> str:
    """Corners, area, and outer rings less holes, from the patterns of two by two cells around each point of a window's grid."""
    cells = _area_sql(rule).rsplit("SELECT window_id, CAST(sum", 1)[0]
    return f"""{cells}, ix AS (SELECT window_id, a, row_number() OVER (PARTITION BY window_id ORDER BY a) AS i FROM ex), iy AS (SELECT window_id, a, row_number() OVER (PARTITION BY window_id ORDER BY a) AS j FROM ey),
      lit AS (SELECT c.window_id, i, j, (x2 - x1) * (y2 - y1) AS area FROM (SELECT * FROM cell WHERE {rule}) c JOIN ix ON c.window_id = ix.window_id AND c.x1 = ix.a JOIN iy ON c.window_id = iy.window_id AND c.y1 = iy.a),
      quad AS (SELECT window_id, i + di AS i, j + dj AS j, sum(1 << (di * 2 + dj)) AS bits, count(*) AS n FROM lit, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj) GROUP BY ALL),
      turn AS (SELECT window_id, CASE WHEN n IN (1, 3) THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END AS corners, CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END AS turns FROM quad)
      SELECT window_id, CAST(sum(corners) AS BIGINT) AS n_corners, CAST(sum(turns) // 4 AS BIGINT) AS outer_less_holes, (SELECT CAST(sum(area) AS BIGINT) FROM lit WHERE lit.window_id = turn.window_id) AS area FROM turn GROUP BY window_id"""


@query("exp_11_rings", _ring_sql("(a OR b) AND NOT c"))
def _(spark, d):
    """The outlines of a formula in each tile: corners, rings and their area."""
    shapes = view(spark, d, "shapes")
    tiles = tiling.tile_grid(spark, tiling.box_of(shapes), 1500)
    found = contours.ring_facts(contours.rings(layer_algebra.apply("(A | B) - C", LAYERS, shapes, tiles), ["window_id"]), ["window_id"])
    sign = F.when(F.col("area") > 0, 1).otherwise(-1)
    return found.groupBy("window_id").agg(F.sum("n_corners").alias("n_corners"), F.sum(sign).alias("outer_less_holes"), F.sum("area").cast("long").alias("area"))


_TRIANGLES = """+near AS (SELECT image_id, layer, x1 - xrel + 750 AS x1, y1 - yrel + 750 AS y1, x2 - xrel + 750 AS x2, y2 - yrel + 750 AS y2 FROM images i JOIN shapes s ON s.x1 <= xrel + 750 AND s.x2 >= xrel - 750 AND s.y1 <= yrel + 750 AND s.y2 >= yrel - 750 WHERE layer IN (10, 12)),
  px AS (SELECT *, greatest(0, x1 // 25 - 1) AS c1, least(59, x2 // 25) AS c2, greatest(0, y1 // 25 - 1) AS r1, least(59, y2 // 25) AS r2 FROM near),
  cells AS (SELECT *, unnest(range(r1, r2 + 1)) AS r FROM (SELECT *, unnest(range(c1, c2 + 1)) AS c FROM px)),
  hit AS (SELECT DISTINCT image_id, layer, c, r FROM cells WHERE c * 25 + 12.5e0 >= x1 AND r * 25 + 12.5e0 >= y1 AND r * 25 + 12.5e0 < y2 AND c * 25 + 12.5e0 < x2 + (r * 25 + 12.5e0 - y1) * (x1 - x2) / CAST(y2 - y1 AS DOUBLE))
  SELECT image_id, CAST(layer AS INTEGER) AS layer, count(*) AS n_pixels FROM hit GROUP BY image_id, layer"""


@query("exp_08_polygon_fill", with_views(_TRIANGLES, "images", "shapes"))
def _(spark, d):
    """Triangles, half of each shape, filled at the centres of each image's pixels."""
    images = view(spark, d, "images").select("image_id", F.col("xrel").alias("cx"), F.col("yrel").alias("cy"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    seen = alignment.in_view(view(spark, d, "shapes").where("layer in (10, 12)"), images, 1500)
    return alignment.polygon_pixels(seen.withColumn("pts", F.array(point("x1", "y1"), point("x1", "y2"), point("x2", "y1"))).drop("x1", "y1", "x2", "y2"), 1500, 60)


_TWICE = "coalesce(list_sum(list_transform(range(1, step + 1), lambda j: list_sum({a}[1:j]))), 0)"


@query("win_07_points", with_views(f"+g AS (SELECT rep_id, [nx, ny, vx, -wy] AS dx, [wy, -nx, ny, vx] AS dy, unnest(range(5)) AS step FROM arrays) SELECT rep_id, step, CAST({_TWICE.format(a='dx')} AS BIGINT) AS x, CAST({_TWICE.format(a='dy')} AS BIGINT) AS y FROM g", "arrays"))
def _(spark, d):
    """Point lists whose numbers change the step from one point to the next."""
    lists = view(spark, d, "arrays").select("rep_id", F.array("nx", "ny", "vx", -F.col("wy")).alias("gx"), F.array("wy", -F.col("nx"), "ny", "vx").alias("gy"))
    points = lists.select("rep_id", F.posexplode(F.arrays_zip(repetition.doubly_running("gx").alias("x"), repetition.doubly_running("gy").alias("y"))).alias("step", "_p"))
    return points.select("rep_id", F.col("step").cast("long").alias("step"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


# turned by an eighth, squares on a corner are boxes of twice the area
_TURNED = """+s AS (SELECT g, layer, cx + cy - r AS x1, cx - cy - r AS y1, cx + cy + r AS x2, cx - cy + r AS y2 FROM diamonds),
  ex AS (SELECT g, x AS a, lead(x) OVER (PARTITION BY g ORDER BY x) AS b FROM (SELECT g, x1 AS x FROM s UNION SELECT g, x2 FROM s)),
  ey AS (SELECT g, y AS a, lead(y) OVER (PARTITION BY g ORDER BY y) AS b FROM (SELECT g, y1 AS y FROM s UNION SELECT g, y2 FROM s)),
  cell AS (SELECT ex.g, ex.a AS x1, ex.b AS x2, ey.a AS y1, ey.b AS y2, bool_or(layer = 10) AS a, bool_or(layer = 11) AS b, bool_or(layer = 12) AS c
    FROM s JOIN ex ON ex.g = s.g AND s.x1 <= ex.a AND s.x2 >= ex.b JOIN ey ON ey.g = s.g AND s.y1 <= ey.a AND s.y2 >= ey.b GROUP BY ALL)
  SELECT g AS window_id, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS twice_area FROM cell WHERE (a OR b) AND NOT c GROUP BY g"""


@query("set_08_polygons", with_views(_TURNED, "diamonds"))
def _(spark, d):
    """A formula on polygons with slanted edges, as trapezoids."""
    rows = view(spark, d, "diamonds").withColumn("cx", F.col("cx") + F.col("g") * 2000)
    at = lambda x, y: F.struct((F.col("cx") + x * F.col("r")).alias("x"), (F.col("cy") + y * F.col("r")).alias("y"))
    polygons = rows.select("layer", F.lit(0).alias("datatype"), F.array(at(1, 0), at(0, 1), at(-1, 0), at(0, -1)).alias("pts"))
    windows = rows.select(F.col("g").alias("window_id")).distinct().select("window_id", *((F.col("window_id") * k + v).alias(c) for c, k, v in (("wx1", 2000, -400), ("wy1", 0, -400), ("wx2", 2000, 1200), ("wy2", 0, 1200))))
    found = layer_algebra.apply_polygons("(A | B) - C", {"A": (10, 0), "B": (11, 0), "C": (12, 0)}, polygons, windows)
    twice = F.sum((F.col("y2") - F.col("y1")) * (F.col("right1") - F.col("left1") + F.col("right2") - F.col("left2")))
    return found.groupBy("window_id").agg(F.round(twice).cast("long").alias("twice_area"))
