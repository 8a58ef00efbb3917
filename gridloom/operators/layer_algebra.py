"""Layer formulas over windows, such as ``L0 = [(A > W:10) & B] < H:10``.

``~`` binds tightest, then ``> W:n`` / ``< H:n`` (grow and shrink along an
axis), then ``&``, then ``|`` and ``-`` from left to right. A formula becomes a
nested tuple on the driver; its names are bound to layers or to other formulas
(recipes). Shapes are joined to windows with the formula's halo by grid buckets,
and each window is worked out from its own shapes in an Arrow task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import raster, regions, trapezoids
from gridloom.functions.geometry import ring_box
from gridloom.operators.ordered import kept
from gridloom.operators.overlap import bbox_join, meeting
from gridloom.operators.tiling import MOST_SHAPES, reaching, split_windows


#: Shapes, and polygons, that are worked on at once, if their windows have no more.
BLOCK_ROWS, BLOCK_POLYGONS = 20_000, 1000


class FormulaError(ValueError):
    """A formula, a binding or a set of recipes makes no sense."""


_TOKEN = re.compile(r"\s*(?:(?P<morph>[<>])\s*(?P<axis>[A-Za-z_]\w*)\s*:\s*(?P<n>\d+(?:\.\d+)?|\.\d+)|(?P<name>[^\W\d]\w*)|(?P<op>[&|~()\[\]=-]))")
_CLOSING = {"(": ")", "[": "]"}


def _tokens(text: str) -> list[tuple]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:]!r}")
        if m["morph"]:
            if m["axis"].upper() not in "WH" or len(m["axis"]) != 1:
                raise FormulaError(f"axis must be W or H, not {m['axis']!r}")
            out.append(("grow" if m["morph"] == ">" else "shrink", m["axis"].upper(), float(m["n"])))
        else:
            out.append(("name", m["name"]) if m["name"] else (m["op"],))
        at = m.end()
    return out


def parse(text: str) -> tuple[str | None, tuple]:
    """(name or None, formula); formulas are ("ref", name), (op, ...) tuples."""
    left = _tokens(text)
    name = None
    if len(left) > 1 and left[0][0] == "name" and left[1] == ("=",):
        name, left = left[0][1], left[2:]
    if not left:
        raise FormulaError("empty formula")
    left.reverse()

    def tight() -> tuple:
        if not left:
            raise FormulaError("formula ends too early")
        kind, *rest = left.pop()
        if kind == "~":
            return ("not", tight())
        if kind == "name":
            return ("ref", rest[0])
        if kind in _CLOSING:
            inner = chain(("|", "-"))
            if not left or left.pop() != (_CLOSING[kind],):
                raise FormulaError(f"{kind!r} is not closed")
            return inner
        raise FormulaError(f"unexpected {kind!r}")

    def moved() -> tuple:
        node = tight()
        while left and left[-1][0] in ("grow", "shrink"):
            kind, axis, n = left.pop()
            node = (kind, node, axis, n)
        return node

    def chain(ops: tuple[str, ...]) -> tuple:
        lower = moved if ops == ("&",) else lambda: chain(("&",))
        node = lower()
        while left and left[-1][0] in ops:
            (op,) = left.pop()
            node = (op, node, lower())
        return node

    tree = chain(("|", "-"))
    if left:
        raise FormulaError(f"unexpected {left[-1][0]!r} after the formula")
    return name, tree


def names(tree: tuple) -> set[str]:
    """The names a formula refers to."""
    return {tree[1]} if tree[0] == "ref" else set().union(*(names(x) for x in tree[1:] if isinstance(x, tuple)))


def recipe_order(recipes: dict[str, tuple]) -> list[str]:
    """Recipes after those they refer to, by name where free; cycles are errors."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise FormulaError("recipes refer to each other: " + " -> ".join([*above, name]))
        if name not in done:
            for other in sorted(names(recipes[name]) & recipes.keys()):
                visit(other, (*above, name))
            done.append(name)

    for name in sorted(recipes):
        visit(name, ())
    return done


def expanded(tree: tuple, recipes: dict[str, tuple], layers: dict[str, tuple[int, int]], above: tuple[str, ...] = ()) -> tuple:
    """The formula with recipes put in; every name must be a layer or a recipe."""
    if tree[0] != "ref":
        return tuple(expanded(x, recipes, layers, above) if isinstance(x, tuple) else x for x in tree)
    name = tree[1]
    if name in layers:
        return tree
    if name in above:
        raise FormulaError("recipes refer to each other: " + " -> ".join([*above, name]))
    if name not in recipes:
        raise FormulaError(f"{name!r} is not bound to a layer or recipe")
    return expanded(recipes[name], recipes, layers, (*above, name))


def halo(tree: tuple) -> float:
    """How far outside a window shapes can matter: moves summed along a path."""
    own = tree[3] if tree[0] in ("grow", "shrink") else 0.0
    return own + max((halo(x) for x in tree[1:] if isinstance(x, tuple)), default=0.0)


def _operands(tree: tuple, bound: dict[str, np.ndarray], field: np.ndarray, algebra) -> tuple[list[np.ndarray], Callable]:
    """Regions, whose parts may overlap, and the rule of their masks that is the formula."""
    op = tree[0]
    if op == "ref":
        return [bound.get(tree[1], algebra.EMPTY)], lambda a: a
    if op in ("grow", "shrink") and tree[3] <= 0:
        return _operands(tree[1], bound, field, algebra)
    if op == "grow":
        return [algebra.moved(evaluate(tree[1], bound, field, algebra), tree[2], tree[3])], lambda a: a
    if op == "shrink":
        empty = evaluate(("not", tree[1]), bound, field, algebra)
        return [algebra.boxed(field), algebra.moved(empty, tree[2], tree[3])], lambda f, a: f & ~a
    left, first = _operands(tree[1], bound, field, algebra)
    if op == "not":
        return [algebra.boxed(field), *left], lambda f, *m: f & ~first(*m)
    right, second = _operands(tree[2], bound, field, algebra)
    rule, n = {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "-": lambda x, y: x & ~y}[op], len(left)
    return [*left, *right], lambda *m: rule(first(*m[:n]), second(*m[n:]))


def evaluate(tree: tuple, bound: dict[str, np.ndarray], field: np.ndarray, algebra=regions, window: np.ndarray | None = None) -> np.ndarray:
    """The region of a formula, cut to ``window`` if given; complements and shrinks are taken in ``field``.

    What lies between two moves is worked out at once. ``algebra`` is the module that
    regions belong to: boxes or trapezoids. Regions and fields may be stacks.
    """
    operands, rule = _operands(tree, bound, field, algebra)
    if window is None:
        return algebra.combined(operands, rule)
    return algebra.combined([algebra.boxed(window), *operands], lambda w, *m: w & rule(*m))


def window_blocks(batches: Iterator[pa.RecordBatch], size: int, *keys: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of whole keys, about ``size`` of them, from batches sorted by key; with each row's key as a number, and where keys begin.

    Keys are numbers. A key with more rows than that comes alone.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def blocks(last: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        nonlocal held, n
        rows = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([rows[c].to_numpy() for c in keys])
        starts = np.r_[0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, len(rows)]
        stop = len(starts) - (1 if last else 2)
        i = 0
        while i < stop:
            j = min(max(int(np.searchsorted(starts, starts[i] + size, "right")) - 1, i + 1), stop)
            part = starts[i : j + 1] - starts[i]
            yield rows.slice(starts[i], part[-1]), np.repeat(np.arange(j - i), np.diff(part)), part[:-1]
            i = j
        held = rows.slice(starts[stop]).to_batches()
        n = len(rows) - starts[stop]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n > size and any(held[0][c][0].as_py() != batch[c][-1].as_py() for c in keys):
                yield from blocks(False)
    if n:
        yield from blocks(True)


def in_windows(shapes: DataFrame, windows: DataFrame, layers: dict[str, tuple[int, int]], grid: int, halo_nm: float, most: int = MOST_SHAPES) -> DataFrame:
    """(window_id, part, px1..py2, ref, x1..y2): shapes near each window, by operand name.

    Where squares are so dense that a window could meet more than ``most`` shapes,
    windows are split to parts; else each is one part. A part without shapes has one
    row with null ``ref``, so complements see it.
    """
    spark = shapes.sparkSession
    bound = spark.createDataFrame([(k, *v) for k, v in layers.items()], "ref string, layer int, datatype int")
    used = shapes.join(F.broadcast(bound), ["layer", "datatype"]).select("ref", "x1", "y1", "x2", "y2")
    parts = windows.select("window_id", F.lit(0).cast("long").alias("part"), *(F.col(f"w{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    near = reaching(parts, halo_nm)
    known = meeting(used, near, grid)
    if 9 * known.most > most:  # a part looks into nine squares at most
        parts = split_windows(windows, used, halo_nm, grid, most)
        near = reaching(parts, halo_nm)
        known = meeting(used, near, grid)
    place = ["window_id", "part", "px1", "py1", "px2", "py2"]
    found = bbox_join(used, near, grid, known).select(*place, "ref", "x1", "y1", "x2", "y2")
    empty = near.select(*place, F.lit(None).cast("string").alias("ref"), *(F.lit(0).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return found.unionByName(empty)


def _worked_out(trees: dict[str, tuple], layers: dict[str, tuple[int, int]], shapes: DataFrame, windows: DataFrame, grid: int, most: int) -> DataFrame:
    """(recipe, window_id, x1..y2) of all formulas, from one join of shapes and windows."""
    around = {name: halo(tree) for name, tree in trees.items()}
    used = {k: v for k, v in layers.items() if any(k in names(tree) for tree in trees.values())}
    rows = in_windows(shapes, windows, used, grid, max(around.values(), default=0.0), most)
    columns = ["recipe", "window_id", "x1", "y1", "x2", "y2"]

    known = pa.array(list(used), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, place, starts in window_blocks(batches, BLOCK_ROWS, "window_id", "part"):
            window = np.stack([group[c].to_numpy()[starts].astype(float) for c in ("px1", "py1", "px2", "py2")] + [np.arange(len(starts))], axis=1)
            b = np.stack([*(group[c].to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")), place], axis=1)
            ref = pc.fill_null(pc.index_in(group["ref"], known), -1).to_numpy()
            held = {k: regions.boxes(b[ref == i]) for i, k in enumerate(used)}
            ids = group["window_id"].to_numpy()[starts]
            for name, tree in trees.items():
                field = window + np.array([-1, -1, 1, 1, 0]) * around[name]
                found = evaluate(tree, {k: regions.clipped(v, field) for k, v in held.items()}, field, window=window)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(ids[found[:, 4].astype(np.int64)]), *(pa.array(found[:, i]) for i in range(4))], columns)

    dealt = rows.repartition("window_id", "part").sortWithinPartitions("window_id", "part")
    return dealt.mapInArrow(work, "recipe string, window_id long, x1 double, y1 double, x2 double, y2 double")


def apply(formula: str, layers: dict[str, tuple[int, int]], shapes: DataFrame, windows: DataFrame, *, grid: int = 2000, recipes: dict[str, str] | None = None, most: int = MOST_SHAPES) -> DataFrame:
    """(window_id, x1, y1, x2, y2): the disjoint boxes of a formula in each window.

    The boxes of a window that was split end where its parts do.
    """
    known = {k: parse(v)[1] for k, v in (recipes or {}).items()}
    recipe_order(known)
    tree = expanded(parse(formula)[1], known, layers)
    return _worked_out({"": tree}, layers, shapes, windows, grid, most).drop("recipe")


def apply_polygons(formula: str, layers: dict[str, tuple[int, int]], polygons: DataFrame, windows: DataFrame, *, grid: int = 2000, recipes: dict[str, str] | None = None) -> DataFrame:
    """(window_id, y1, y2, left1, right1, left2, right2): the trapezoids of a formula in each window.

    ``polygons`` hold layer, datatype and the points ``pts`` of one outline each, in either
    direction; edges may be slanted. A window without polygons counts for complements.
    """
    known = {k: parse(v)[1] for k, v in (recipes or {}).items()}
    recipe_order(known)
    tree = expanded(parse(formula)[1], known, layers)
    around = halo(tree)
    used = {k: v for k, v in layers.items() if k in names(tree)}
    bound = polygons.sparkSession.createDataFrame([(k, *v) for k, v in used.items()], "ref string, layer int, datatype int")
    # written once, as the boxes around are read often
    boxed = kept(polygons.join(F.broadcast(bound), ["layer", "datatype"]).select("ref", "pts", *(c.alias(n) for c, n in zip(ring_box(F.col("pts")), ("x1", "y1", "x2", "y2"), strict=True))))
    parts = windows.select("window_id", *(F.col(f"w{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    place_columns = ["px1", "py1", "px2", "py2"]
    found = bbox_join(boxed, reaching(parts, around), grid).select("window_id", *place_columns, "ref", "pts")
    rows = found.unionByName(parts.select("window_id", *place_columns, F.lit(None).cast("string").alias("ref"), F.lit(None).cast(found.schema["pts"].dataType).alias("pts")))
    columns = ["window_id", "y1", "y2", "left1", "right1", "left2", "right2"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, place, starts in window_blocks(batches, BLOCK_POLYGONS, "window_id"):
            window = np.stack([group[c].to_numpy()[starts].astype(float) for c in place_columns] + [np.arange(len(starts))], axis=1)
            field = window + np.array([-1, -1, 1, 1, 0]) * around
            held, valid = {}, pc.is_valid(group["ref"])
            drawn = group.filter(valid)
            if len(drawn):
                edges, of = raster.ring_edges(*raster.ring_points(drawn["pts"]))
                edges = np.concatenate([edges, place[valid.to_numpy()][of][:, None]], axis=1)
                ref = np.array(drawn["ref"].to_pylist(), object)[of]
                held = {k: trapezoids.clipped(trapezoids.from_edges(edges[ref == k]), field) for k in used}
            out = evaluate(tree, held, field, trapezoids, window)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(group["window_id"].to_numpy()[starts][out[:, 6].astype(np.int64)]), *(pa.array(out[:, i]) for i in range(6))], columns)

    return rows.repartition("window_id").sortWithinPartitions("window_id").mapInArrow(work, "window_id long, " + ", ".join(f"{c} double" for c in columns[1:]))


def binding(value) -> tuple:
    """A binding in its tagged form: ("raw", layer, datatype) or ("ref", recipe)."""
    parts = tuple(value)
    if len(parts) == 2 and parts[0] == "ref":
        return ("ref", str(parts[1]))
    if len(parts) == 3 and parts[0] == "raw":
        parts = parts[1:]
    if len(parts) != 2 or parts[0] in ("raw", "ref"):
        raise FormulaError(f"{value!r} is no binding")
    return ("raw", int(parts[0]), int(parts[1]))


def apply_all(recipes: dict[str, str], layers: dict[str, tuple[int, int]], shapes: DataFrame, windows: DataFrame, *, grid: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(recipe, window_id, x1..y2) of all recipes, and (recipe, message) of those that fail.

    A recipe that cannot be read, or that leads to itself or to an unknown name,
    is left out with its message; so is one that needs such a recipe. The others share
    one join of shapes and windows.
    """
    spark = shapes.sparkSession
    errors: list[tuple[str, str]] = []
    known: dict[str, tuple] = {}
    for name, text in recipes.items():
        try:
            known[name] = parse(text)[1]
        except FormulaError as e:
            errors.append((name, str(e)))
    good = {}
    for name in sorted(known):
        try:
            good[name] = expanded(known[name], known, layers, (name,))
        except FormulaError as e:
            errors.append((name, str(e)))
    return _worked_out(good, layers, shapes, windows, grid, MOST_SHAPES), spark.createDataFrame(errors, "recipe string, message string")


def sidecar(recipes: dict[str, str], bindings: dict[str, dict], colors: dict[str, str]) -> list[dict]:
    """Recipes with their bindings and colours, as they are written next to a layout."""
    return [{"name": k, "expr": v, "bindings": {n: list(binding(b)) for n, b in bindings.get(k, {}).items()}, "color": colors.get(k)} for k, v in recipes.items()]


def point_types(outlines: DataFrame) -> DataFrame:
    """(point_type, n, rectilinear_pct): outlines by the type of their point list, and the
    share of all outlines that this type adds to those with axis-parallel edges (types 0 and 1)."""
    counted = outlines.groupBy("point_type").agg(F.count("*").alias("n"))
    total = outlines.agg(F.count("*").alias("_all"))
    straight = F.when(F.col("point_type") <= 1, F.col("n")).otherwise(0)
    return counted.join(F.broadcast(total)).select("point_type", "n", F.round(straight * 100.0 / F.col("_all"), 6).alias("rectilinear_pct"))
