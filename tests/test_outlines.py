"""Rings of regions and filled polygons against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.functions import regions as R
from gridloom.functions import trapezoids as T
from gridloom.operators import contours
from gridloom.operators import layer_algebra as L


def frame(spark, b, key=0):
    return spark.createDataFrame([(key, *map(float, r)) for r in b], "w long, x1 double, y1 double, x2 double, y2 double")


def ring_list(spark, b, by=("w",)):
    out = {}
    for r in contours.rings(frame(spark, b), list(by)).orderBy("ring", "seq").collect():
        out.setdefault(r.ring, []).append(r)
    for corners in out.values():
        assert [r.seq for r in corners] == list(range(len(corners)))
        for a, c in zip(corners, corners[1:] + corners[:1], strict=True):
            assert (a.nx, a.ny) == (c.x, c.y) and (a.x == a.nx) != (a.y == a.ny)
    return [[(r.x, r.y) for r in corners] for corners in out.values()]


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2


def test_a_frame_has_a_hole(spark):
    b = R.combined([R.boxes([(0, 0, 10, 10)]), R.boxes([(3, 3, 6, 6)])], lambda x, y: x & ~y)
    assert sorted(map(area, ring_list(spark, b))) == [-9, 100]


def test_corners_that_touch_are_apart(spark):
    assert sorted(map(area, ring_list(spark, [(0, 0, 1, 1), (1, 1, 2, 2)]))) == [1, 1]
    hole = R.combined([R.boxes([(0, 0, 4, 4)]), R.boxes([(1, 1, 2, 2), (2, 2, 3, 3)])], lambda x, y: x & ~y)
    assert sum(map(area, ring_list(spark, hole))) == 14


def test_rings_go_across_tiles(spark):
    b = R.dissolved(np.array([(0, 0, 40, 4), (36, 0, 40, 40), (0, 36, 40, 40), (0, 0, 4, 40)], float))
    tiles = [R.clipped(b, np.array([x, y, x + 10, y + 10], float)) for x in range(0, 40, 10) for y in range(0, 40, 10)]
    found = ring_list(spark, np.concatenate(tiles), by=())
    assert sorted(map(area, found)) == [-32 * 32, 1600] and sorted(map(len, found)) == [4, 4]


def test_random_regions(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        b = R.dissolved(rng.integers(0, 25, (25, 4)))
        rings = ring_list(spark, b)
        assert sum(map(area, rings)) == R.area(b)
        mask = np.zeros((27, 27), bool)
        for x1, y1, x2, y2 in b.astype(int):
            mask[y1 + 1 : y2 + 1, x1 + 1 : x2 + 1] = True
        quads = mask[:-1, :-1].astype(int) + mask[1:, :-1] + mask[:-1, 1:] + mask[1:, 1:]
        cross = (quads == 2) & (mask[:-1, :-1] == mask[1:, 1:])
        assert sum(map(len, rings)) == ((quads == 1) | (quads == 3)).sum() + 2 * cross.sum()
    assert contours.rings(frame(spark, np.zeros((0, 4))), ["w"]).count() == 0


def around(points, x, y):
    """How often the outline goes around a point, by crossings to its left."""
    n = 0
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1], strict=True):
        if (ya <= y) != (yb <= y) and xa + (y - ya) * (xb - xa) / (yb - ya) <= x:
            n += 1 if yb < ya else -1
    return n


@pytest.mark.parametrize("even_odd", [False, True])
def test_filled_polygons(even_odd):
    rng = np.random.default_rng(3)
    for _ in range(60):
        polygons = [rng.integers(-30, 130, (int(rng.integers(3, 8)), 2)).tolist() for _ in range(int(rng.integers(1, 5)))]
        starts = np.cumsum([0, *map(len, polygons)])[:-1]
        edges, of = raster.ring_edges(np.concatenate([np.array(p) for p in polygons]), starts)
        got = raster.filled(edges, np.zeros(len(edges), np.int64), 1, 0, 0, 5.0, 20, 20, even_odd)[0]
        turned = [p if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) >= 0 else p[::-1] for p in polygons]
        for r in range(20):
            for c in range(20):
                n = sum(around(p, (c + 0.5) * 5, (19 - r + 0.5) * 5) for p in turned)
                assert got[r, c] == (n % 2 != 0 if even_odd else n != 0)


def polygon_region(polygons):
    starts = np.cumsum([0, *map(len, polygons)])[:-1]
    edges, _ = raster.ring_edges(np.concatenate([np.array(p, float) for p in polygons]), starts)
    return T.from_edges(edges)


def holds(region, x, y):
    y1, y2, left1, right1, left2, right2 = region.T
    part = (y - y1) / (y2 - y1)
    return bool(((y1 <= y) & (y < y2) & (left1 + part * (left2 - left1) <= x) & (x < right1 + part * (right2 - right1))).any())


def test_trapezoids_of_random_triangles():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = ([rng.integers(0, 60, (3, 2)).tolist() for _ in range(int(rng.integers(1, 5)))] for _ in range(2))
        ra, rb = polygon_region(a), polygon_region(b)
        inside = lambda ps, x, y: any(around(p, x, y) for p in ps)
        for rule in (lambda p, q: p & q, lambda p, q: p | q, lambda p, q: p & ~q):
            found = T.combined([ra, rb], rule)
            for x, y in rng.uniform(0, 60, (40, 2)):
                assert holds(found, x, y) == bool(rule(np.bool_(inside(a, x, y)), np.bool_(inside(b, x, y))))


def test_trapezoids_have_closed_areas():
    field = np.array([-100, -100, 100, 100.0])
    diamond = polygon_region([[(10, 0), (0, 10), (-10, 0), (0, -10)]])
    assert T.area(diamond) == 200 and len(diamond) == 2
    assert T.area(T.grown(diamond, "W", 5)) == pytest.approx(200 + 20 * 10)
    assert T.area(T.grown(diamond, "H", 5)) == pytest.approx(200 + 20 * 10)
    assert T.area(T.shrunk(diamond, "W", 5, field)) == pytest.approx(50)
    assert T.area(T.shrunk(T.grown(diamond, "H", 3), "H", 3, field)) == pytest.approx(200)
    assert T.area(T.complement(diamond, field)) == 40_000 - 200
    assert T.area(T.clipped(diamond, np.array([0, 0, 50, 50.0]))) == 50
    star = polygon_region([[(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]])
    assert T.area(star) == pytest.approx(100 - 35)
    assert T.dissolved(T.EMPTY).shape == (0, 6) and T.area(T.combined([diamond, T.EMPTY], lambda a, b: a & ~b)) == 200


def test_trapezoids_of_boxes_have_the_area_of_boxes():
    rng = np.random.default_rng(6)
    field = np.array([0, 0, 40, 40.0])
    for text in ("(A > W:3) - B", "(A | B) < H:2", "~A & (B > H:4)"):
        a, b = (R.boxes(rng.integers(0, 40, (12, 4))) for _ in range(2))
        slanted = {k: T.dissolved(np.stack([v[:, 1], v[:, 3], v[:, 0], v[:, 2], v[:, 0], v[:, 2]], axis=1)) for k, v in (("A", a), ("B", b))}
        tree = L.parse(text)[1]
        assert T.area(T.clipped(L.evaluate(tree, slanted, field, T), field)) == pytest.approx(R.area(R.clipped(L.evaluate(tree, {"A": a, "B": b}, field), field)))


def test_a_stack_of_polygons_gives_what_its_planes_give():
    rng = np.random.default_rng(12)
    fields = np.array([[0, 0, 60, 60, 0], [10, 0, 50, 60, 1], [0, 0, 60, 60, 2]], float)

    def triangles(n):
        p = rng.integers(0, 60, (n, 3, 2)).astype(float)
        return raster.ring_edges(p.reshape(-1, 2), np.arange(n) * 3)[0]

    planes = {name: {k: triangles(n) for k in (0, 2)} for name, n in (("A", 6), ("B", 4))}
    stacks = {name: T.clipped(T.from_edges(np.concatenate([np.insert(e, 4, k, axis=1) for k, e in own.items()])), fields) for name, own in planes.items()}
    for text in ("A & B", "~A", "(A > W:3) - B", "(A > H:2) & B", "(A | B) < H:1"):
        tree = L.parse(text)[1]
        found = L.evaluate(tree, stacks, fields, T, fields)
        for k, field in enumerate(fields[:, :4]):
            own = {name: T.clipped(T.from_edges(e.get(k, np.zeros((0, 4)))), field) for name, e in planes.items()}
            alone = L.evaluate(tree, own, field, T, field)
            assert np.allclose(found[found[:, 6] == k][:, :6], alone), (text, k)


def test_rings_that_lead_through_many_chunks(spark):
    rng = np.random.default_rng(13)
    spiral = [(0, 0, 50, 2), (48, 2, 50, 50), (2, 48, 48, 50), (2, 6, 4, 48), (4, 6, 44, 8), (60, 0, 62, 2), (62, 2, 64, 4)]
    rows = [(0, *map(float, r)) for r in spiral] + [(1, *r) for r in R.dissolved(rng.integers(0, 25, (60, 4))).tolist()]
    boxes = spark.createDataFrame(rows, "w long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    # small batches, so that a chunk holds some of a ring's edges only
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = [contours.rings(boxes, ["w"], chunk).collect() for chunk in (1, 4, 10**6)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shapes = []
    for corners in found:
        rings = {}
        for r in sorted(corners, key=lambda r: (r.w, r.ring, r.seq)):
            rings.setdefault((r.w, r.ring), []).append(r)
        for ring in rings.values():
            assert [r.seq for r in ring] == list(range(len(ring)))
            assert all((a.nx, a.ny) == (b.x, b.y) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        points = [(w, [(r.x, r.y) for r in ring]) for (w, _), ring in rings.items()]
        shapes.append(sorted((w, p[p.index(min(p)):] + p[: p.index(min(p))]) for w, p in points))
    assert shapes[0] == shapes[1] == shapes[2]
