"""Formulas and regions: closed forms, and a raster version of random cases."""

import numpy as np
import pytest

from gridloom.functions import regions as R
from gridloom.operators import layer_algebra as L
from gridloom.operators import tiling

A, B, FIELD = R.boxes([(0, 0, 10, 10)]), R.boxes([(5, 0, 15, 10)]), np.array([0, 0, 20, 10.0])


def value(text, field=FIELD, **bound):
    return L.evaluate(L.parse(text)[1], bound or {"A": A, "B": B}, field)


@pytest.mark.parametrize("text,area", [("A & B", 50), ("A | B", 150), ("A - B", 50), ("~A", 100), ("A > W:5", 200), ("A - B - B", 50), ("A | B & A", 100), ("~A & B", 50), ("A > W:0", 100)])
def test_areas(text, area):
    assert R.area(value(text)) == area


def test_grow_bounds_and_shrink():
    g = value("A > W:5")
    assert (g[:, 0].min(), g[:, 1].min(), g[:, 2].max(), g[:, 3].max()) == (-5, 0, 15, 10)
    big = np.array([-50, -50, 50, 50.0])
    assert R.area(value("A < H:2", big)) == 60
    assert R.area(value("L = [(A > W:1) & B] < H:1", big, A=A, B=A)) == 80


def raster(b, n):
    m = np.zeros((n, n), bool)
    for x1, y1, x2, y2 in b.astype(int):
        m[y1:y2, x1:x2] = True
    return m


def test_random_regions_match_a_raster():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = 40
        a, b = (R.boxes(rng.integers(0, n, (rng.integers(1, 12), 4))) for _ in range(2))
        field = np.array([0, 0, n, n], float)
        ra, rb = raster(a, n), raster(b, n)
        for text, mask in (("A & B", ra & rb), ("A | B", ra | rb), ("A - B", ra & ~rb), ("~A", ~ra)):
            got = value(text, field, A=a, B=b)
            assert (raster(got, n) == mask).all() and R.area(got) == mask.sum()
        wide = np.zeros_like(ra)
        for s in range(-3, 4):
            wide |= np.roll(np.pad(ra, ((0, 0), (3, 3))), s, axis=1)[:, 3:-3]
        assert (raster(R.clipped(value("A > W:3", field, A=a), field), n) == wide).all()


@pytest.mark.parametrize("text", ["", "A &", "(A", "A > X:3", "A > W", "A B", "A = ", "A $ B", "& A", "[A)"])
def test_bad_formulas(text):
    with pytest.raises(L.FormulaError):
        L.parse(text)


def test_recipes():
    recipes = {k: L.parse(v)[1] for k, v in {"R1": "A & B", "R2": "R1 > W:3", "R3": "R2 - R1"}.items()}
    assert L.recipe_order(recipes) == ["R1", "R2", "R3"]
    assert L.halo(L.expanded(("grow", ("ref", "R3"), "H", 4.0), recipes, {"A": (1, 0), "B": (2, 0)})) == 7
    with pytest.raises(L.FormulaError):
        L.recipe_order({"X": ("ref", "Y"), "Y": ("ref", "X")})
    with pytest.raises(L.FormulaError):
        L.expanded(("ref", "nobody"), recipes, {})


def test_windows_tile_a_formula(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 3)), 0, int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(rng.integers(0, 900, 200), rng.integers(0, 900, 200), rng.integers(1, 80, 200), rng.integers(1, 80, 200))]
    shapes = spark.createDataFrame(rows, "layer int, datatype int, x1 long, y1 long, x2 long, y2 long")
    tiles = tiling.tile_grid(spark, (0, 0, 1000, 1000), 300)
    assert tiles.count() == 16
    layers = {"A": (1, 0), "B": (2, 0)}
    whole = spark.createDataFrame([(0, 0, 0, 1000, 1000)], "window_id long, wx1 long, wy1 long, wx2 long, wy2 long")
    for text in ("A & B", "(A > W:20) - B", "~(A | B)", "R < H:5"):
        areas = [L.apply(text, layers, shapes, w, grid=200, recipes={"R": "A > W:10"}).selectExpr("sum((x2 - x1) * (y2 - y1)) as a").first().a for w in (tiles, whole)]
        assert abs(areas[0] - areas[1]) < 1e-6, text


def test_tile_grid_edges(spark):
    t = tiling.tile_grid(spark, (0, 0, 1000, 10), 300).orderBy("window_id").collect()
    assert [r.wx1 for r in t] == [0, 250, 500, 750] and t[-1].wx2 == 1000
    assert tiling.tile_grid(spark, (5, 5, 5, 5), 10).count() == 1
    assert tiling.tile_grid(spark, (0, 0, 10**6, 1), 10).count() == 64


def test_raster_form_equals_vector_form():
    from gridloom.functions import raster as P

    rng = np.random.default_rng(5)
    n = 40
    field = np.array([0, 0, n, n], float)
    for _ in range(30):
        a, b = (R.boxes(rng.integers(0, n, (rng.integers(1, 10), 4))) for _ in range(2))
        masks = {"A": raster(a, n), "B": raster(b, n)}
        for text in ("A & B", "A | ~B", "A - B", "(A > W:3) & B", "(A | B) < H:2", "(A > H:1) - (B < W:2)"):
            tree = L.parse(text)[1]
            got = R.clipped(L.evaluate(tree, {"A": a, "B": b}, field), field)
            assert (P.evaluate(tree, masks, 1.0) == raster(got, n)).all(), text


def test_pictures():
    import struct
    import zlib

    from gridloom.functions import raster as P

    labels = np.array([[0, 1], [2, 3]], np.uint8)
    colors = P.colored(labels, np.array([[255, 0, 0], [0, 255, 0]]))
    assert colors[0, 0].tolist() == [0, 0, 0] and colors[0, 1].tolist() == [255, 0, 0] == colors[1, 1].tolist()
    raw = P.png(colors)
    assert struct.unpack(">II", raw[16:24]) == (2, 2) and raw[25] == 2
    at = raw.index(b"IDAT")
    (size,) = struct.unpack(">I", raw[at - 4 : at])
    assert zlib.decompress(raw[at + 4 : at + 4 + size]) == b"".join(b"\0" + r.tobytes() for r in colors)


def test_sparse_windows_are_not_swept(monkeypatch):
    rng = np.random.default_rng(9)
    low = rng.integers(0, 37_000, (2200, 2))
    b = np.concatenate([low, low + rng.integers(20, 220, (2200, 2))], axis=1).astype(float)
    field = np.array([0, 0, 37_500, 37_500.0])
    monkeypatch.setattr(R, "SMALL", 0)
    swept = value("A < H:5", field, A=b)
    monkeypatch.undo()
    monkeypatch.setattr(R, "swept", None)
    assert np.array_equal(value("A < H:5", field, A=b), swept)


@pytest.mark.parametrize("small", [R.SMALL, 30])
def test_a_stack_gives_what_its_planes_give(monkeypatch, small):
    rng = np.random.default_rng(10)
    monkeypatch.setattr(R, "SMALL", small)
    fields = np.array([[0, 0, 40, 40, 0], [5, 5, 30, 30, 1], [0, 0, 40, 40, 2], [0, 10, 40, 20, 3]], float)
    a, b = (np.concatenate([np.insert(R.boxes(rng.integers(0, 40, (n, 4))), 4, k, axis=1) for k in (0, 1, 3)]) for n in (12, 7))
    for text in ("A & B", "~A", "(A > W:3) - B", "(A | B) < H:2", "(B - A) > H:1", "A > W:0"):
        stack = value(text, fields, A=R.clipped(a, fields), B=R.clipped(b, fields))
        for k, field in enumerate(fields[:, :4]):
            own = value(text, field, **{n: R.clipped(x[x[:, 4] == k][:, :4], field) for n, x in (("A", a), ("B", b))})
            assert np.array_equal(stack[stack[:, 4] == k][:, :4] if len(stack) else stack, own), (text, k)


def test_blocks_hold_whole_windows():
    import pyarrow as pa

    ids = np.repeat(np.arange(9), [1, 4, 30, 2, 2, 2, 1, 12, 3])
    rows = pa.table({"w": ids, "part": ids * 0, "at": np.arange(len(ids))})
    for batch in (1, 5, 100):
        found = list(L.window_blocks(iter(rows.to_batches(batch)), 6, "w", "part"))
        assert np.concatenate([r["at"].to_numpy() for r, _, _ in found]).tolist() == list(range(len(ids)))
        for r, place, starts in found:
            w = r["w"].to_numpy()
            assert (w[starts][place] == w).all() and len(set(w)) == len(starts) and (len(r) <= 6 or len(starts) == 1)
        assert sum(len(s) for _, _, s in found) == 9
