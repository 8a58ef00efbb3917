"""Operators against plain versions on small cases that bite."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.operators import alignment, defects, hierarchy, layer_algebra, ordered, overlap, repetition, results
from gridloom.streaming import live

_EDGE = "parent long, child long, x long, y long, q int, flip boolean"
_RECT = "cell_id long, x1 long, y1 long, x2 long, y2 long"


def test_overlaps_of_all_sizes(spark):
    rnd = random.Random(1)
    box = lambda w: (lambda x, y: (x, y, x + rnd.randint(0, w), y + rnd.randint(0, w)))(rnd.randint(-3000, 3000), rnd.randint(-3000, 3000))
    shapes = [(i, *box(rnd.choice([0, 5, 80, 900, 5000]))) for i in range(150)] + [(999, -9000, -9000, 9000, 9000)]
    queries = [(i, *box(rnd.choice([0, 50, 700]))) for i in range(60)]
    left = spark.createDataFrame(shapes, "id int, x1 long, y1 long, x2 long, y2 long")
    right = spark.createDataFrame(queries, "qid int, qx1 long, qy1 long, qx2 long, qy2 long")
    got = sorted((r.id, r.qid) for r in overlap.bbox_join(left, right, 100).select("id", "qid").collect())
    expected = sorted((s[0], q[0]) for s in shapes for q in queries if s[1] <= q[3] and s[3] >= q[1] and s[2] <= q[4] and s[4] >= q[2])
    assert got == expected and {q for s, q in got if s == 999} == set(range(60))
    assert overlap.bbox_join(left.limit(0), right, 100).count() == 0


def test_running_results_of_sparse_orders(spark):
    rnd = random.Random(2)
    keys = sorted(rnd.sample(range(-(10**12), 10**12), 400))
    rows = [(k, rnd.randint(0, 9), rnd.choice([None, k])) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long, s long").repartition(5)
    total, seen, sums, last, following = 0, None, {}, {}, dict(zip(keys, [*keys[1:], None], strict=True))
    for k, v, s in rows:
        sums[k], total = total, total + v
        seen = seen if s is None else s
        last[k] = seen
    assert {r.k: r.t for r in ordered.running_total(df, "k", F.col("v"), "t").collect()} == sums
    assert {r.k: r.t for r in ordered.last_seen(df, "k", F.col("s"), "t").collect()} == last
    assert {r.k: r.t for r in ordered.next_value(df, "k", "t").collect()} == following
    assert ordered.running_total(df.limit(0), "k", F.col("v"), "t").count() == 0


def test_bounds_and_levels_of_cyclic_graphs(spark):
    # 0 places 1 twice; 1 and 2 place each other; 2 places itself and 3; 4 places the unknown 9
    edges = [(0, 1, 100, 0, 0, False), (0, 1, -50, 0, 0, False), (1, 2, 10, 0, 0, False), (2, 1, 0, 7, 0, False), (2, 2, 1, 1, 0, False), (2, 3, 0, 1000, 0, False), (4, 9, 5, 5, 0, False)]
    placement = spark.createDataFrame(edges, _EDGE)
    rects = spark.createDataFrame([(1, 0, 0, 4, 4), (2, 0, 0, 2, 2), (3, 0, 0, 1, 1), (4, 1, 1, 2, 2)], _RECT)
    own = {1: (0, 0, 4, 4), 2: (0, 0, 2, 2), 3: (0, 0, 1, 1), 4: (1, 1, 2, 2)}

    def bounds(cell, path):
        found = [own[cell]] if cell in own else []
        for p, c, x, y, _, _ in edges:
            if p == cell and c not in path and (b := bounds(c, {*path, c})):
                found.append((b[0] + x, b[1] + y, b[2] + x, b[3] + y))
        return (min(b[0] for b in found), min(b[1] for b in found), max(b[2] for b in found), max(b[3] for b in found)) if found else None

    expected = {c: b for c in range(10) if (b := bounds(c, {c}))}
    assert {r.cell_id: (r.x1, r.y1, r.x2, r.y2) for r in hierarchy.subtree_bounds(placement, rects).collect()} == expected
    assert {r.cell_id: r.level for r in hierarchy.levels(placement, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert [(r.child, r.n) for r in hierarchy.unknown_targets(placement, rects).collect()] == [(9, 1)]


def test_layer_names_by_brute_force(spark):
    rnd = random.Random(3)
    names = [(f"n{i}", i, a := rnd.randint(0, 40), rnd.choice([None, a, a + 3, a + 30]), b := rnd.randint(0, 4), rnd.choice([None, b, b + 2])) for i in range(60)]
    keys = [(i % 45, i % 6) for i in range(200)]
    wide = 2**31 - 1

    def plain(layer, kind):
        held = [((hi if hi is not None else wide) - lo, (e if e is not None else wide) - d, n, name) for name, n, lo, hi, d, e in names if not (lo == 0 and hi is None) and lo <= layer <= (wide if hi is None else hi) and d <= kind <= (wide if e is None else e)]
        return min(held)[3] if held else ""

    got = defects.layer_name(spark.createDataFrame(keys, "layer int, datatype int"), spark.createDataFrame(names, "name string, rec_no int, l_lo int, l_hi int, d_lo int, d_hi int"))
    assert {(r.layer, r.datatype): r.name for r in got.collect()} == {k: plain(*k) for k in set(keys)}


def drawn(boxes, x0, y0, scale, height, width):
    out = np.zeros((height, width), bool)
    for x1, y1, x2, y2 in boxes:
        c1, c2 = (int(np.rint((x - x0) / scale)) for x in (x1, x2))
        r2, r1 = (height - 1 - int(np.rint((y - y0) / scale)) for y in (y1, y2))
        for r in range(height):
            for c in range(width):
                out[r, c] |= c1 <= c <= c2 and r1 <= r <= r2
    return out


def test_masks_and_labels_pixel_by_pixel():
    rng = np.random.default_rng(4)
    low = rng.integers(-60, 160, (40, 2))
    boxes = np.concatenate([low, low + rng.integers(0, 60, (40, 2))], axis=1).astype(float)
    plane, ids = rng.integers(0, 3, 40), rng.integers(1, 5, 40)
    found = raster.masks(boxes, plane, 3, -10, 5, 7.5, 14, 16)
    named = raster.label_planes(boxes, ids, plane, 3, -10, 5, 7.5, 14, 16)
    for k in range(3):
        assert (found[k] == drawn(boxes[plane == k], -10, 5, 7.5, 14, 16)).all()
        layers = [drawn(boxes[(plane == k) & (ids == i)], -10, 5, 7.5, 14, 16) * i for i in range(1, 5)]
        assert (named[k] == np.max(layers, axis=0)).all()
    assert not raster.masks(np.zeros((0, 4)), np.zeros(0, int), 2, 0, 0, 1, 3, 3).any()


def test_runs_cover_a_mask_once():
    rng = np.random.default_rng(5)
    image = rng.random((20, 30)) > 0.4
    back = np.zeros(image.shape, int)
    for r1, c1, r2, c2 in raster.runs(image):
        back[r1:r2, c1:c2] += 1
    assert (back == image).all() and len(raster.runs(np.zeros((3, 3), bool))) == 0


def test_a_stack_of_matches_equals_single_ones():
    rng = np.random.default_rng(6)
    images = raster.blurred((rng.random((5, 40, 40)) > 0.7).astype(float), 1.2)
    images[2] = 1
    rolled = np.roll(images, (2, -1), axis=(1, 2))
    got = raster.matches(images, rolled, 6, 3.0)
    assert np.allclose(got, [raster.match(a, b, 6, 3.0) for a, b in zip(images, rolled, strict=True)])
    assert (got[2] == 0).all() and got[0][2] > 0.9


def test_states_of_images(spark):
    rows = [(1, True, True, 25.0), (2, False, False, 0.0), (3, True, False, 0.0), (4, True, True, 0.0), (5, True, True, None), (6, True, True, 25.0)]
    images = spark.createDataFrame([(i, c, f, s, 1000 * i, 1000, 25.0, 0.0) for i, c, f, s in rows], "image_id long, has_coords boolean, has_file boolean, nm_per_px double, cx long, cy long, ox double, oy double")
    shapes = spark.createDataFrame([(10, 900, 950, 1010, 1080), (10, 1040, 900, 1090, 990), (11, 960, 1000, 1000, 1020)], "layer int, x1 long, y1 long, x2 long, y2 long")
    got = {r.image_id: (r.status, r.dx_nm, r.score) for r in alignment.matched(images, shapes, {10: 90, 11: 200}, 300, 60, 10).collect()}
    assert {i: s for i, (s, _, _) in got.items()} == {1: "ok", 2: "no-coords", 3: "missing-file", 4: "no-scale", 5: "no-scale", 6: "flat"}
    assert abs(got[1][1] + 25) < 3 and got[1][2] > 0.9 and got[6][2] == 0


def test_lists_of_gaps(spark):
    rows = [(4, 9, [3, 4], [1, 1]), (5, 2, [3, 4], [1, 1]), (6, 9, [3, 4], [1, 1]), (7, 2, [3], [0]), (10, 9, [3, -4], [1, 2]), (11, 2, [3, -4], [1, 2])]
    df = spark.createDataFrame(rows, "rtype int, grid long, gaps_x array<long>, gaps_y array<long>")
    got = {}
    for r in repetition.expand_lists(df).orderBy("rtype", "step").collect():
        got.setdefault(r.rtype, []).append((r.dx, r.dy))
    assert got == {4: [(0, 0), (3, 0), (7, 0)], 5: [(0, 0), (6, 0), (14, 0)], 6: [(0, 0), (0, 3), (0, 7)], 7: [(0, 0), (0, 6)], 10: [(0, 0), (3, 1), (-1, 3)], 11: [(0, 0), (6, 2), (-2, 6)]}


def test_image_entries_and_layouts(spark):
    rows = [("a", 1, 2, ["7", "2", "p1", "x", "p2", "y"]), ("a", 2, 1, ["8", "1", "p3", "z"]), ("a", 3, 3, ["9", "3", "p4"]), ("b", 1, 1, ["7", "1", "Images", "1", "{", "5", "t", "}"]), ("c", 1, 0, ["1", "0"])]
    df = spark.createDataFrame(rows, "path string, rec_no int, n_pages int, tokens array<string>")
    entries = df.where("path = 'a'").orderBy("rec_no").select(defects.image_entries("tokens", F.col("n_pages"), F.lit(2), F.lit(2)).alias("e")).collect()
    assert [r.e for r in entries] == [[["p1", "x"], ["p2", "y"]], [["p3", "z"]], []]
    found = {r.path: (r.start, r.per_image, r.how) for r in defects.image_layout(df, columns=2, count_at=1, list_at=None).collect()}
    assert found == {"a": (2, 2, "inferred"), "b": (2, None, "images18")}
    assert {r.how for r in defects.image_layout(df, 3, 1, 2, declared=2).collect()} == {"declared", "images18"}
    braced = spark.createDataFrame([("Images 2 {1 tif, 2 tif}", 2), ("Images 2 {1 tif}", 2), ("none", 1)], "t string, n int").select(defects.braced_entries("t", F.col("n")).alias("e")).collect()
    assert [r.e for r in braced] == [[["1", "tif"], ["2", "tif"]], [], []]


def test_recipes_fail_alone(spark):
    shapes = spark.createDataFrame([(10, 0, 0, 0, 50, 50), (11, 0, 20, 20, 90, 90)], "layer int, datatype int, x1 long, y1 long, x2 long, y2 long")
    windows = spark.createDataFrame([(1, 0, 0, 100, 100)], "window_id long, wx1 long, wy1 long, wx2 long, wy2 long")
    recipes = {"both": "A & B", "more": "both | A", "bad": "A &", "self": "self - A", "lost": "A | X", "needs": "bad | A"}
    found, errors = layer_algebra.apply_all(recipes, {"A": (10, 0), "B": (11, 0)}, shapes, windows)
    areas = {r.recipe: r.a for r in found.groupBy("recipe").agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("a")).collect()}
    assert areas == {"both": 900, "more": 2500} and {r.recipe for r in errors.collect()} == {"bad", "self", "lost", "needs"}
    assert layer_algebra.binding((3, 1)) == layer_algebra.binding(("raw", 3, 1)) == ("raw", 3, 1) and layer_algebra.binding(["ref", "x"]) == ("ref", "x")
    for bad in ((), (1,), ("raw", 1), ("x", 1, 2)):
        with pytest.raises(layer_algebra.FormulaError):
            layer_algebra.binding(bad)
    assert layer_algebra.sidecar({"r": "A"}, {"r": {"A": (10, 0)}}, {"r": "#fff"}) == [{"name": "r", "expr": "A", "bindings": {"A": ["raw", 10, 0]}, "color": "#fff"}]


def test_numbers_as_text(spark):
    values = [0.0005, -0.0005, -0.0004, 12.3456, None, 1234.0, 0.9996]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(results.fixed_point(F.col("v"), 3).alias("t")).collect()
    assert [r.t for r in got] == ["0.001", "-0.001", "0.000", "12.346", "", "1234.000", "1.000"]


def test_latest_row_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("b", 2, 7), ("a", 2, 8)], "op string, seq long, us long")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.latest(stream, "op", "seq").writeStream.outputMode("complete").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("newest").collect())) == [("a", 3, 6), ("b", 2, 7)]
