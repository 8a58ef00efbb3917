"""The cell graph: expanding placements, bounds of subtrees, roots and levels.

The graph is walked level by level: the frontier of (root, cell, transform) rows
is joined with the placements, one shuffle a level, pruned by the query box
before any geometry is read. Unknown cells end a path; a cell that is its own
ancestor is skipped, as is anything below ``MAX_DEPTH``.

Placements and shapes may be arrays: ``nx`` by ``ny`` elements, stepped along (vx, vy)
and (wx, wy). Arrays stay descriptors: the query box is turned back into the parent's
coordinates, which leaves a range of indices of each array, and only those elements
are ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import moved_box, turn_matrix
from gridloom.operators.ordered import kept
from gridloom.operators.overlap import touches

MAX_DEPTH = 128
_BOX = ["x1", "y1", "x2", "y2"]
_STATE = ["cell_id", "a", "b", "c", "d", "tx", "ty"]
_LATTICE = ["nx", "ny", "vx", "vy", "wx", "wy"]


def _matrix(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{v}") for v in "abcd"]


def _descend(frontier: DataFrame, placement: DataFrame) -> DataFrame:
    """Frontier rows one level down: M = Mp * Mc, t = Mp * tc + tp."""
    edges = placement.select("parent", "child", "x", "y", *(c.alias(f"e{v}") for v, c in zip("abcd", turn_matrix(F.col("q"), F.col("flip")), strict=True)))
    m, e = _matrix(), _matrix("e")
    product = [m[0] * e[0] + m[1] * e[2], m[0] * e[1] + m[1] * e[3], m[2] * e[0] + m[3] * e[2], m[2] * e[1] + m[3] * e[3]]
    joined = frontier.join(edges, F.col("cell_id") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
    return joined.select(
        F.col("child").alias("cell_id"),
        *(p.alias(v) for p, v in zip(product, "abcd", strict=True)),
        (m[0] * F.col("x") + m[1] * F.col("y") + F.col("tx")).alias("tx"),
        (m[2] * F.col("x") + m[3] * F.col("y") + F.col("ty")).alias("ty"),
        F.array_append("path", F.col("child")).alias("path"),
    )


def instances(placement: DataFrame, root: int, bounds: DataFrame | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(cell_id, a, b, c, d, tx, ty): every instance of every cell under ``root``.

    With ``bounds`` (cell_id, x1..y2 of its subtree) and a ``box``, subtrees
    that cannot touch the box are left out before they are expanded.
    """
    spark = placement.sparkSession
    start = spark.range(1).select(F.lit(root).cast("long").alias("cell_id"), *(F.lit(v).alias(n) for v, n in zip((1, 0, 0, 1), "abcd", strict=True)), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.array(F.lit(root).cast("long")).alias("path"))
    levels = [frontier := start]
    for _ in range(MAX_DEPTH):
        frontier = _descend(frontier, placement)
        if bounds is not None and box is not None:
            below = bounds.select("cell_id", *(F.col(c).alias(f"_{c}") for c in _BOX))
            frontier = frontier.join(below, "cell_id")
            where = moved_box(_matrix(), [F.col("tx"), F.col("ty")], [F.col(f"_{c}") for c in _BOX])
            frontier = frontier.where(touches(where, [F.lit(v) for v in box])).drop(*(f"_{c}" for c in _BOX))
        frontier = kept(frontier)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(*_STATE)


def flattened(placed: DataFrame, rects: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Rectangles (cell_id, x1..y2 in the root's coordinates, other columns) of the instances."""
    more = [c for c in rects.columns if c not in ("cell_id", *_BOX)]
    own = rects.select("cell_id", *(F.col(c).alias(f"_{c}") for c in _BOX), *(F.col(c).alias(f"own_{c}") for c in more))
    there = moved_box(_matrix(), [F.col("tx"), F.col("ty")], [F.col(f"_{c}") for c in _BOX])
    out = placed.join(own, "cell_id").select("cell_id", *(F.col(f"own_{c}").alias(c) for c in more), *(c.alias(n) for c, n in zip(there, _BOX, strict=True)))
    return out if box is None else out.where(touches([F.col(c) for c in _BOX], [F.lit(v) for v in box]))


def _lifted(edges: DataFrame, below: DataFrame) -> DataFrame:
    """(cell_id, x1..y2): the children's boxes in their parents' coordinates."""
    held = below.select(F.col("cell_id").alias("child"), *(F.col(c).alias(f"_{c}") for c in _BOX))
    up = moved_box(_matrix(), [F.col("x"), F.col("y")], [F.col(f"_{c}") for c in _BOX])
    return edges.join(held, "child").select(F.col("parent").alias("cell_id"), *(c.alias(n) for c, n in zip(up, _BOX, strict=True)))


def subtree_bounds(placement: DataFrame, rects: DataFrame) -> DataFrame:
    """(cell_id, x1..y2): the box around a cell's own and all placed shapes.

    Cells are done bottom up, each once all that it places are done, so there are
    as many rounds as levels. Cells on a cycle or above one are never due; for
    them a placement that leads back to a cell on the way down is skipped. A cell
    without shapes below has no row.
    """
    around = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), _BOX, strict=True)]
    edges = kept(placement.select("parent", "child", "x", "y", *(c.alias(v) for v, c in zip("abcd", turn_matrix(F.col("q"), F.col("flip")), strict=True))))
    cells = edges.select(F.col("parent").alias("cell_id")).union(edges.select("child")).union(rects.select("cell_id")).distinct()
    cells = kept(cells.join(rects.groupBy("cell_id").agg(*around), "cell_id", "left"))
    pairs = kept(edges.select("parent", "child").distinct())
    done = cells.limit(0)
    while True:
        ready = done.select("cell_id")
        todo = cells.join(ready, "cell_id", "left_anti")
        waiting = pairs.join(ready.withColumnRenamed("cell_id", "child"), "child", "left_anti").select(F.col("parent").alias("cell_id"))
        due = todo.join(waiting.distinct(), "cell_id", "left_anti")
        of_due = edges.join(due.select(F.col("cell_id").alias("parent")), "parent", "left_semi")
        fresh = kept(due.unionByName(_lifted(of_due, done)).groupBy("cell_id").agg(*around))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    todo = kept(todo)
    if not todo.isEmpty():
        done = done.unionByName(_cyclic_bounds(edges, todo, done, around))
    return done.where("x1 is not null")


def _cyclic_bounds(edges: DataFrame, todo: DataFrame, done: DataFrame, around: list[Column]) -> DataFrame:
    """Boxes of the cells of ``todo``, along all ways down that meet no cell twice."""
    inside = kept(_lifted(edges.join(todo.select(F.col("cell_id").alias("parent")), "parent", "left_semi"), done).unionByName(todo).groupBy("cell_id").agg(*around))
    between = kept(edges.join(todo.select(F.col("cell_id").alias("parent")), "parent", "left_semi").join(todo.select(F.col("cell_id").alias("child")), "child", "left_semi"))
    m, e = _matrix("m"), _matrix()
    way = todo.select(F.col("cell_id").alias("start"), "cell_id", *(F.lit(v).alias(f"m{n}") for v, n in zip((1, 0, 0, 1), "abcd", strict=True)), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.array("cell_id").alias("path"))
    found = None
    for _ in range(MAX_DEPTH):
        there = moved_box(m, [F.col("tx"), F.col("ty")], [F.col(c) for c in _BOX])
        boxes = way.join(inside, "cell_id").select(F.col("start").alias("cell_id"), *(c.alias(n) for c, n in zip(there, _BOX, strict=True)))
        found = boxes if found is None else found.unionByName(boxes)
        product = [m[0] * e[0] + m[1] * e[2], m[0] * e[1] + m[1] * e[3], m[2] * e[0] + m[3] * e[2], m[2] * e[1] + m[3] * e[3]]
        step = way.join(between, F.col("cell_id") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        way = kept(step.select("start", F.col("child").alias("cell_id"), *(p.alias(f"m{n}") for p, n in zip(product, "abcd", strict=True)), (m[0] * F.col("x") + m[1] * F.col("y") + F.col("tx")).alias("tx"), (m[2] * F.col("x") + m[3] * F.col("y") + F.col("ty")).alias("ty"), F.array_append("path", F.col("child")).alias("path")))
        if way.isEmpty():
            break
    return found.groupBy("cell_id").agg(*around)


def root_cell(placement: DataFrame, rects: DataFrame) -> DataFrame:
    """One row: the cell to start from.

    Of the cells that nothing places (or of all, if every cell is placed), the
    one with most placements, then most rectangles, then the largest id.
    """
    cells = placement.select(F.col("parent").alias("cell_id")).union(placement.select("child")).union(rects.select("cell_id")).distinct()
    free = cells.join(placement.select(F.col("child").alias("cell_id")).distinct(), "cell_id", "left_anti").withColumn("free", F.lit(1))
    counted = cells.join(free, "cell_id", "left").join(placement.groupBy(F.col("parent").alias("cell_id")).agg(F.count("*").alias("n_placed")), "cell_id", "left").join(rects.groupBy("cell_id").agg(F.count("*").alias("n_rects")), "cell_id", "left").na.fill(0)
    best = F.max(F.struct("free", "n_placed", "n_rects", "cell_id")).alias("s")
    return counted.agg(best).select("s.cell_id", "s.n_placed", "s.n_rects")


def levels(placement: DataFrame, root: int) -> DataFrame:
    """(cell_id, level): longest path from the root, so parents come first.

    A cell is due once all cells under the root that place it have their level.
    Where a cycle keeps all others waiting, the smallest cell that one with a level
    places is due, and its other placements count as closing the cycle.
    """
    edges = kept(placement.select("parent", "child").where("parent <> child").distinct())
    start = placement.sparkSession.range(1).select(F.lit(root).cast("long").alias("cell_id"))
    reached = frontier = kept(start)
    while not frontier.isEmpty():
        below = frontier.join(edges, F.col("cell_id") == F.col("parent")).select(F.col("child").alias("cell_id")).distinct()
        frontier = kept(below.join(reached, "cell_id", "left_anti"))
        reached = reached.unionByName(frontier)
    todo = kept(reached.where(F.col("cell_id") != root))
    used = kept(edges.join(reached.select(F.col("cell_id").alias("parent")), "parent", "left_semi"))
    done = kept(start.withColumn("level", F.lit(0)))
    while not todo.isEmpty():
        offered = used.join(todo.select(F.col("cell_id").alias("child")), "child", "left_semi").join(done.select(F.col("cell_id").alias("parent"), "level"), "parent", "left")
        state = offered.groupBy(F.col("child").alias("cell_id")).agg(F.count_if(F.col("level").isNull()).alias("waits"), (F.max("level") + 1).alias("level"))
        state = kept(state.where("level is not null"))
        fresh = state.where("waits = 0").select("cell_id", "level")
        if fresh.isEmpty():
            fresh = state.orderBy("cell_id").limit(1).select("cell_id", "level")
        fresh = kept(fresh)
        done = done.unionByName(fresh)
        todo = kept(todo.join(fresh.select("cell_id"), "cell_id", "left_anti"))
    return done


def unknown_targets(placement: DataFrame, cells: DataFrame) -> DataFrame:
    """(child, n): placements of cells that have neither shapes nor placements."""
    known = cells.select(F.col("cell_id").alias("child")).union(placement.select("parent")).distinct()
    return placement.join(known, "child", "left_anti").groupBy("child").agg(F.count("*").alias("n"))


def flattened_polygons(placed: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons (cell_id, pts) of the instances, point by point in the root's coordinates."""
    m = _matrix()
    own = polygons.select("cell_id", F.col("pts").alias("_pts"))
    move = lambda p: F.struct((m[0] * p["x"] + m[1] * p["y"] + F.col("tx")).alias("x"), (m[2] * p["x"] + m[3] * p["y"] + F.col("ty")).alias("y"))
    return placed.join(own, "cell_id").select("cell_id", F.transform("_pts", move).alias("pts"))


def region_layers(flat: DataFrame) -> DataFrame:
    """One row for each layer that has shapes in the region: their number and the box around them."""
    around = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), _BOX, strict=True)]
    return flat.groupBy("layer", "datatype").agg(F.count("*").alias("n"), *around)


def corners(placement: DataFrame) -> DataFrame:
    """The arrays' outermost elements as single placements; they span the same box."""
    ends = [F.array_distinct(F.array(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("nx", "ny")]
    each = placement.where("nx > 0 and ny > 0").withColumn("_i", F.explode(ends[0])).withColumn("_j", F.explode(ends[1]))
    moved = {c: F.col(c) + F.col("_i") * F.col(f"v{c}") + F.col("_j") * F.col(f"w{c}") for c in "xy"}
    return each.withColumns(moved).drop("_i", "_j", *_LATTICE)


def _ranged(rows: DataFrame, box: list[str], query: list[str]) -> DataFrame:
    """``_i0`` to ``_j1``: first and last index along both steps of elements of ``box`` that can touch ``query``.

    Offsets that touch lie in a box; its corners, in steps of the lattice, bound the
    indices. A step that is not taken is replaced by one across the other; where both
    steps are along one line all indices are left in. Worked out in steps with columns
    of their own, so that no step's code repeats the one before.
    """
    col = F.col
    pick = lambda n, m, own, x, y: F.when(col(n) > 1, col(own)).when(col(m) > 1, y).otherwise(x).cast("double")
    steps = {"_vx": pick("nx", "ny", "vx", F.lit(1), col("wy")), "_vy": pick("nx", "ny", "vy", F.lit(0), -col("wx")), "_wx": pick("ny", "nx", "wx", F.lit(0), -col("vy")), "_wy": pick("ny", "nx", "wy", F.lit(1), col("vx"))}
    offsets = {"_lx": col(query[0]) - col(box[2]), "_ly": col(query[1]) - col(box[3]), "_hx": col(query[2]) - col(box[0]), "_hy": col(query[3]) - col(box[1])}
    found = rows.withColumns(steps | offsets).withColumn("_det", col("_vx") * col("_wy") - col("_vy") * col("_wx"))
    corners_ = [(col(x), col(y)) for x in ("_lx", "_hx") for y in ("_ly", "_hy")]
    at = {f"_{n}{k}": (x * col(f"_{o}y") - y * col(f"_{o}x")) * sign / col("_det") for n, o, sign in (("i", "w", 1), ("j", "v", -1)) for k, (x, y) in enumerate(corners_, 2)}
    found = found.withColumns({k: F.when(col("_det") != 0, v) for k, v in at.items()})
    ends = {}
    for k, n in (("i", "nx"), ("j", "ny")):
        four = [col(f"_{k}{c}") for c in range(2, 6)]
        # a hair to the outside, as division is not exact; elements are tested afterwards
        ends[f"_{k}0"] = F.coalesce(F.greatest(F.ceil(F.least(*four) - 1e-6), F.lit(0)).cast("long"), F.lit(0))
        ends[f"_{k}1"] = F.coalesce(F.least(F.floor(F.greatest(*four) + 1e-6).cast("long"), col(n) - 1), col(n) - 1)
    return found.withColumns(ends).drop(*steps, *offsets, *at, "_det")


def _elements(rows: DataFrame, box: list[str], query: list[str]) -> DataFrame:
    """The array elements (``_dx``, ``_dy``) whose ``box`` touches ``query``, both named columns."""
    own, asked = [F.col(c) for c in box], [F.col(c) for c in query]
    # outer, as else a filter with all that leads to the indices would be inferred and pushed down
    within = lambda k: F.explode_outer(F.when(F.col(f"_{k}0") <= F.col(f"_{k}1"), F.sequence(f"_{k}0", f"_{k}1")))
    each = _ranged(rows, box, query).withColumn("_i", within("i")).withColumn("_j", within("j"))
    each = each.withColumns({f"_d{c}": F.col("_i") * F.col(f"v{c}") + F.col("_j") * F.col(f"w{c}") for c in "xy"})
    there = [c + F.col(d) for c, d in zip(own, ("_dx", "_dy", "_dx", "_dy"), strict=True)]
    return each.where(touches(there, asked)).drop("_i0", "_i1", "_j0", "_j1", "_i", "_j", *box, *query)


def _turned_back(box: tuple[int, int, int, int]) -> dict[str, Column]:
    """The query box in the coordinates of a frontier's cell."""
    m = _matrix()
    ends = [F.lit(v).cast("long") - F.col(t) for v, t in zip(box, ("tx", "ty", "tx", "ty"), strict=True)]
    return {f"_q{c}": v for c, v in zip(_BOX, moved_box([m[0], m[2], m[1], m[3]], [F.lit(0), F.lit(0)], ends), strict=True)}


def walk_arrays(placement: DataFrame, root: int, bounds: DataFrame, box: tuple[int, int, int, int]) -> tuple[DataFrame, list[dict]]:
    """Instances under ``root`` whose subtree touches ``box``, of placements that are arrays, and counters.

    ``bounds`` come from :func:`subtree_bounds` of :func:`corners`. Counters have one
    row a level: array placements met, their elements, the largest array, placements
    skipped because they lead back to a cell on the way down, instances kept, and
    elements pruned. They are aggregates of what a level joins and keeps.
    """
    spark = placement.sparkSession
    edges = placement.select("parent", "child", "x", "y", *_LATTICE, *(c.alias(f"e{v}") for v, c in zip("abcd", turn_matrix(F.col("q"), F.col("flip")), strict=True)))
    below = bounds.select(F.col("cell_id").alias("child"), *(F.col(c).alias(f"_{c}") for c in _BOX))
    one = [1, 0, 0, 1]
    frontier = spark.range(1).select(F.lit(root).cast("long").alias("cell_id"), *(F.lit(v).alias(n) for v, n in zip(one, "abcd", strict=True)), F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), F.array(F.lit(root).cast("long")).alias("path"))
    levels, counters = [frontier], []
    m, e = _matrix(), _matrix("e")
    product = [m[0] * e[0] + m[1] * e[2], m[0] * e[1] + m[1] * e[3], m[2] * e[0] + m[3] * e[2], m[2] * e[1] + m[3] * e[3]]
    for level in range(1, MAX_DEPTH + 1):
        again = F.array_contains("path", F.col("child"))
        n = F.when(~again, F.col("nx") * F.col("ny"))
        joined = frontier.withColumns(_turned_back(box)).join(edges, F.col("cell_id") == F.col("parent"))
        seen = joined.agg(F.count(n).alias("placements"), F.coalesce(F.sum(n), F.lit(0)).alias("elements"), F.coalesce(F.max(n), F.lit(0)).alias("largest"), F.count_if(again).alias("skipped")).first().asDict()
        if not seen["placements"] and not seen["skipped"]:
            break
        there = moved_box(e, [F.col("x"), F.col("y")], [F.col(f"_{c}") for c in _BOX])
        held = joined.where(~again).join(below, "child").withColumns({f"_b{c}": v for c, v in zip(_BOX, there, strict=True)})
        inside = _elements(held, [f"_b{c}" for c in _BOX], [f"_q{c}" for c in _BOX])
        x, y = F.col("x") + F.col("_dx"), F.col("y") + F.col("_dy")
        moved = inside.select(
            F.col("child").alias("cell_id"), *(p.alias(v) for p, v in zip(product, "abcd", strict=True)),
            (m[0] * x + m[1] * y + F.col("tx")).alias("tx"), (m[2] * x + m[3] * y + F.col("ty")).alias("ty"), F.array_append("path", F.col("child")).alias("path"),
        )
        frontier = kept(moved)
        n_kept = frontier.count()
        counters.append({"level": level, **seen, "kept": n_kept, "pruned": seen["elements"] - n_kept})
        if not n_kept:
            break
        levels.append(frontier)
    out = levels[0]
    for frontier in levels[1:]:
        out = out.unionByName(frontier)
    return out.select(*_STATE), counters


def flattened_arrays(placed: DataFrame, arrays: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Rectangles (cell_id, x1..y2, other columns) that touch ``box``, of shapes that are arrays."""
    more = [c for c in arrays.columns if c not in ("cell_id", *_BOX, *_LATTICE)]
    own = arrays.select("cell_id", *_LATTICE, *(F.col(c).alias(f"_b{c}") for c in _BOX), *(F.col(c).alias(f"_o{c}") for c in _BOX), *(F.col(c).alias(f"own_{c}") for c in more))
    inside = _elements(placed.withColumns(_turned_back(box)).join(own, "cell_id"), [f"_b{c}" for c in _BOX], [f"_q{c}" for c in _BOX])
    at = [F.col(f"_o{c}") + F.col(d) for c, d in zip(_BOX, ("_dx", "_dy", "_dx", "_dy"), strict=True)]
    there = moved_box(_matrix(), [F.col("tx"), F.col("ty")], at)
    return inside.select("cell_id", *(F.col(f"own_{c}").alias(c) for c in more), *(c.alias(n) for c, n in zip(there, _BOX, strict=True)))


def instance_counts(placement: DataFrame, root: int) -> DataFrame:
    """(cell_id, n): how often each cell occurs under ``root``, without making one instance.

    Counts go down level by level, multiplied by the sizes of arrays. The graph must
    have no cycles; a way down ends below ``MAX_DEPTH``.
    """
    edges = kept(placement.groupBy("parent", "child").agg(F.sum(F.col("nx") * F.col("ny")).alias("times")))
    frontier = placement.sparkSession.range(1).select(F.lit(root).cast("long").alias("cell_id"), F.lit(1).cast("long").alias("n"))
    out = frontier
    for _ in range(MAX_DEPTH):
        frontier = kept(frontier.join(edges, F.col("cell_id") == F.col("parent")).groupBy(F.col("child").alias("cell_id")).agg(F.sum(F.col("n") * F.col("times")).alias("n")))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.groupBy("cell_id").agg(F.sum("n").alias("n"))
