"""Overlap joins, windows, sweeps and arrays against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import regions as R
from gridloom.operators import defects, hierarchy, layer_algebra, overlap, tiling

BOX = "x1 long, y1 long, x2 long, y2 long"


def boxes(rng, n, side, sizes):
    at = rng.integers(-side, side, (n, 2))
    wide = np.minimum(rng.choice(sizes, (n, 1)) * (1 + rng.random((n, 2))), side).astype(int)
    return [(k, *map(int, (*a, *(a + w)))) for k, (a, w) in enumerate(zip(at, wide, strict=True))]


def pairs(spark, shapes, queries, grid, **more):
    s = spark.createDataFrame(shapes, f"sid long, {BOX}")
    q = spark.createDataFrame(queries, "qid long, qx1 long, qy1 long, qx2 long, qy2 long")
    known = overlap.meeting(s, q, grid, **more)
    found = sorted((r.sid, r.qid) for r in overlap.bbox_join(s, q, grid, known).select("sid", "qid").collect())
    expected = sorted((a[0], b[0]) for a in shapes for b in queries if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    assert found == expected
    return known, found


@pytest.mark.parametrize("shape_sizes,query_sizes", [([5], [30]), ([1, 300, 5000], [40]), ([2, 60, 900], [1, 100, 4000]), ([600], [1]), ([0], [0, 16, 64, 256])])
def test_levels_on_both_sides(spark, shape_sizes, query_sizes):
    rng = np.random.default_rng(1)
    shapes, queries = boxes(rng, 300, 600, shape_sizes), boxes(rng, 80, 600, query_sizes)
    shapes += [(900, 64, 64, 64, 64), (901, -16, -16, 0, 0)]  # on edges of squares
    known, found = pairs(spark, shapes, queries, 16)
    assert len(found) > 5 or query_sizes == [0, 16, 64, 256]
    known, _ = pairs(spark, shapes, queries, 16, part_rows=1)
    assert known.hot or shape_sizes == [600]


def test_no_rows(spark):
    rng = np.random.default_rng(2)
    some = boxes(rng, 5, 100, [5])
    assert pairs(spark, [], some, 16)[1] == [] and pairs(spark, some, [], 16)[1] == []


def test_a_query_looks_into_few_squares(spark):
    rng = np.random.default_rng(3)
    s = spark.createDataFrame(boxes(rng, 200, 10**6, [3, 50, 900, 20_000, 300_000]), f"sid long, {BOX}")
    q = spark.createDataFrame(boxes(rng, 50, 10**6, [3, 2000, 700_000]), "qid long, qx1 long, qy1 long, qx2 long, qy2 long")
    m = overlap.meeting(s, q, 16)
    boxed = overlap.normalized("qx1", "qy1", "qx2", "qy2")
    rows = overlap.with_level(q, boxed, 16, "_asked")
    looks = F.size(overlap._looks(boxed, F.col("_asked"), 0, 16, m.largest(F.col("_asked")))) + F.size(overlap._among(m.shape_levels, F.col("_asked"), True))
    assert rows.agg(F.max(looks)).first()[0] <= 16


def test_two_shapes_on_a_wide_chip(spark):
    far = 40_000_000
    shapes = spark.createDataFrame([(1, 0, 0, 0, 50, 50), (1, 0, far, far, far + 50, far + 50)], f"layer int, datatype int, {BOX}")
    tiles = tiling.tile_grid(spark, tiling.box_of(shapes), 1500)
    cut = tiling.clip_to_tiles(shapes, tiles, 2000)
    assert sorted((r.window_id, r.x2 - r.x1) for r in cut.collect()) == [(0, 50), (4095, 50)]
    areas = layer_algebra.apply("A > W:10", {"A": (1, 0)}, shapes, tiles).groupBy("window_id").agg(F.sum(F.expr("(x2 - x1) * (y2 - y1)")).alias("a"))
    assert sorted(map(tuple, areas.collect())) == [(0, 60 * 50), (4095, 60 * 50)]  # the chip ends where the shapes do


def test_half_of_all_shapes_in_one_square(spark):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.integers(0, 300, (400, 2)), rng.integers(0, 10_000, (400, 2))])
    rows = [(int(rng.integers(1, 3)), 0, int(x), int(y), int(x + w), int(y + h)) for (x, y), (w, h) in zip(at, rng.integers(1, 40, (800, 2)), strict=True)]
    shapes = spark.createDataFrame(rows, f"layer int, datatype int, {BOX}")
    windows = spark.createDataFrame([(0, 0, 0, 5000, 10_000), (1, 5000, 0, 10_000, 10_000)], "window_id long, wx1 long, wy1 long, wx2 long, wy2 long")
    parts = tiling.split_windows(windows, shapes, 20, 500, most=60)
    near = overlap.bbox_join(shapes, tiling.reaching(parts, 20), 500).groupBy("window_id", "part", "px1", "px2").count().collect()
    assert all(r["count"] <= 60 or r.px2 - r.px1 <= 20 for r in near) and parts.count() > 8
    area = parts.agg(F.sum(F.expr("(px2 - px1) * (py2 - py1)"))).first()[0]
    assert area == 10_000 * 10_000
    layers = {"A": (1, 0), "B": (2, 0)}
    for text in ("A - B", "~A & (B > W:9)", "(A | B) < H:4"):
        sums = [sorted((r.window_id, r.a) for r in layer_algebra.apply(text, layers, shapes, windows, grid=500, most=most).groupBy("window_id").agg(F.sum(F.expr("(x2 - x1) * (y2 - y1)")).alias("a")).collect()) for most in (60, 10**6)]
        assert sums[0] == sums[1], text


def test_nearest_in_a_dense_square(spark, monkeypatch):
    rnd = random.Random(5)
    points = [(k, rnd.randint(0, 50), rnd.randint(0, 50)) for k in range(200)]
    queries = [(k, rnd.randint(-20, 70), rnd.randint(-20, 70)) for k in range(40)]
    monkeypatch.setattr(overlap, "PART_ROWS", 10)
    found = defects.nearest(spark.createDataFrame(points, "image_id long, x long, y long"), spark.createDataFrame(queries, "query_id long, qx long, qy long"), 9)
    expected = []
    for q, qx, qy in queries:
        near = [((x - qx) ** 2 + (y - qy) ** 2, -k) for k, x, y in points if (x - qx) ** 2 + (y - qy) ** 2 <= 81]
        expected += [(q, -min(near)[1], min(near)[0])] if near else []
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_sweep_gives_the_boxes_of_the_grid(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (R.boxes(rng.integers(0, 30, (rng.integers(0, 40), 4))) for _ in range(2))
        for rule in (lambda x, y: x & y, lambda x, y: x | y, lambda x, y: x & ~y):
            monkeypatch.setattr(R, "SMALL", 10**6)
            grid = R.combined([a, b], rule)
            monkeypatch.setattr(R, "SMALL", 0)
            assert np.array_equal(grid, R.combined([a, b], rule))


@pytest.mark.parametrize("tall", [False, True])
def test_sweep_of_many_boxes(tall):
    n, rng = 12_000, np.random.default_rng(7)
    x = np.arange(n) * 10.0
    b = np.stack([x, rng.integers(0, 100, n), x + 5, 10**6 + rng.integers(0, 10**6, n)], axis=1) if tall else (lambda at: np.concatenate([at, at + rng.integers(1, 3000, (n, 2))], axis=1))(rng.integers(0, 10**7, (n, 2))).astype(float)
    found = R.dissolved(b)
    if tall:
        assert len(found) == n
    inside = [((found[:, 0] <= px) & (px < found[:, 2]) & (found[:, 1] <= py) & (py < found[:, 3])).sum() for px, py in b[:200, :2]]
    assert inside == [1] * 200


def plain_elements(nx, ny, vx, vy, wx, wy, box, query):
    out = []
    for i, j in itertools.product(range(nx), range(ny)):
        dx, dy = i * vx + j * wx, i * vy + j * wy
        if box[0] + dx <= query[2] and box[2] + dx >= query[0] and box[1] + dy <= query[3] and box[3] + dy >= query[1]:
            out.append((dx, dy))
    return sorted(out)


def test_elements_of_arrays(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(300):
        nx, ny = rnd.choice([1, 1, 2, 7]), rnd.choice([1, 1, 3, 5])
        v, w = ((rnd.randint(-12, 12), rnd.randint(-12, 12)) for _ in range(2))
        if k % 9 == 0:
            w = (2 * v[0], 2 * v[1])  # along one line
        x, y, qx, qy = (rnd.randint(-40, 40) for _ in range(4))
        rows.append((k, nx, ny, *v, *w, x, y, x + rnd.randint(0, 9), y + rnd.randint(0, 9), qx, qy, qx + rnd.randint(0, 30), qy + rnd.randint(0, 30)))
    df = spark.createDataFrame(rows, "k long, nx long, ny long, vx long, vy long, wx long, wy long, b1 long, b2 long, b3 long, b4 long, q1 long, q2 long, q3 long, q4 long")
    found = {}
    for r in hierarchy._elements(df, ["b1", "b2", "b3", "b4"], ["q1", "q2", "q3", "q4"]).collect():
        found.setdefault(r.k, []).append((r["_dx"], r["_dy"]))
    for k, *lattice in rows:
        assert sorted(found.get(k, [])) == plain_elements(*lattice[:6], lattice[6:10], lattice[10:]), lattice


def test_a_large_array_gives_few_candidates(spark):
    df = spark.createDataFrame([(500, 500, 100, 0, 0, 100, 0, 0, 90, 90, 20_010, 30_020, 20_150, 30_150)], "nx long, ny long, vx long, vy long, wx long, wy long, b1 long, b2 long, b3 long, b4 long, q1 long, q2 long, q3 long, q4 long")
    r = hierarchy._ranged(df, ["b1", "b2", "b3", "b4"], ["q1", "q2", "q3", "q4"]).first()
    assert (r["_i1"] - r["_i0"] + 1) * (r["_j1"] - r["_j0"] + 1) <= 25


def test_walk_of_arrays_with_a_cycle(spark):
    schema = "parent long, child long, x long, y long, q int, flip boolean, nx long, ny long, vx long, vy long, wx long, wy long"
    placed = spark.createDataFrame([(0, 1, 0, 0, 1, False, 3, 2, 1000, 0, 0, 500), (1, 2, 5, 5, 0, True, 4, 1, 60, 10, 0, 0), (2, 1, 0, 0, 0, False, 2, 2, 9, 0, 0, 9)], schema)
    rects = spark.createDataFrame([(2, 0, 0, 10, 10)], f"cell_id long, {BOX}")
    bounds = hierarchy.subtree_bounds(hierarchy.corners(placed), rects)
    everywhere = (-10**6, -10**6, 10**6, 10**6)
    found, counters = hierarchy.walk_arrays(placed, 0, bounds, everywhere)
    assert sorted(r["count"] for r in found.groupBy("cell_id").count().collect()) == [1, 6, 24]
    assert [(c["placements"], c["elements"], c["largest"], c["skipped"], c["kept"], c["pruned"]) for c in counters] == [(1, 6, 6, 0, 6, 0), (6, 24, 4, 0, 24, 0), (0, 0, 0, 24, 0, 0)]
    nowhere, counters = hierarchy.walk_arrays(placed, 0, bounds, (10**6, 10**6, 10**6 + 1, 10**6 + 1))
    assert nowhere.count() == 1 and counters == [{"level": 1, "placements": 1, "elements": 6, "largest": 6, "skipped": 0, "kept": 0, "pruned": 6}]
