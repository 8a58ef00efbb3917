"""Near-duplicate groups by a chosen-path set similarity join.

Words are runs of anything but ASCII white space, A-Z in lower case; a text's
set holds the hashes of its distinct five-word shingles (a shorter text: its
whole word sequence as one). Rows with equal sets are one vertex from then on.

Each of ``TREES`` independent trees sends a vertex to a node by one minwise
value. A node of more than ``SMALL`` vertices is branched again: two further
minwise positions, chosen by the node's own path among four that only this tree
and depth use, send each vertex to two children. Branching ends when a node is small, when its vertices are alike on
the whole (most share one child), or at ``DEPTH``. Small nodes are compared
exhaustively; large ones in blocks that all hold the node's pivot. A pair of
similarity 0.85 shares an end node in one tree with a chance of 0.815 (0.733 at
0.8), so eight trees miss it with a chance of 1.4 in a million (one in 39,000);
by simulation of nodes that all branch to the last depth.

Comparison goes by sketches first and is confirmed on full sets:

1. every vertex is linked with its smallest likely partner, and the link is
   confirmed;
2. in small nodes, likely pairs whose ends are still in different components are
   confirmed where they stand, in the first tree in which the two share a small
   node;
3. in large nodes, vertices outside the main component are compared with all of
   the node, tile by tile.

No link between different texts is lost to the size of a node, and no list of
pairs is written: tasks get vertices and give links that join components.

Defined cases: texts without words have the empty set and are linked with
nothing; null ids count shingles but belong to no component and are kept;
repeated rows each get a row of their own; of equal texts and of a component the
smallest id stands for all; a very long text has one set like any other, made
and compared in one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_keys, measured, measured_keys

WORDS = 5
THRESHOLD = 0.8
TREES, CHOICE = 8, 4
#: Bytes of the sketch that pairs are compared by; deviations allowed below the threshold.
FINE, ALLOWED = 256, 4.0
SMALL, DEPTH, TILE = 96, 6, 1000
#: Minwise values: a root's for each tree, then those of each depth that branches, by tree.
POSITIONS = TREES + TREES * CHOICE * (DEPTH - 1)
#: Rows of a step that one task takes, about; and rows with full sets.
ROWS, FULL_ROWS = 20_000, 4_000
#: A node is alike on the whole if one child holds this share of it.
ALIKE = 0.6
#: Up to so many vertices (16 bytes each) are broadcast; more are shuffled.
BROADCAST_VERTICES = 1_000_000
#: Up to so many edges are joined without a look at how many a vertex has.
FEW_EDGES = 100_000

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _RANDOM.integers(0, 2**31, (FINE, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 2**32, (FINE, 1), np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text."""
    words = text.encode("utf-8", "replace").lower().split() if text else ()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    mixed = np.full(n, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : j + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Minwise values of the roots, 16 bits of those to branch by, and one byte of each of FINE."""
    least = np.full(FINE, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 1024):
        part = short[start : start + 1024] * _MULTIPLY
        part += _ADD
        least = np.minimum(least, part.min(axis=1))
    return least[:TREES].view(np.int32), least[TREES:POSITIONS].astype(np.uint16).view(np.int16), least.astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _vertex(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sets(docs: DataFrame) -> DataFrame:
    """(row, n_shingles, vertex, sketch, paths, fine) and any columns but text; the last four null without words."""
    text = docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column(text).to_pylist()]
            parts = [sketch(x) if len(x) else (None, None, None) for x in found]
            columns = [*(c for i, c in enumerate(batch.columns) if i != text), pa.array(map(len, found), pa.int64()), pa.array([_vertex(x) if len(x) else None for x in found], pa.binary()), *(pa.array([x[k] for x in parts], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.int16()), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_shingles", "vertex", "sketch", "paths", "fine"])

    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(work, carried + "n_shingles long, vertex binary, sketch array<int>, paths array<smallint>, fine binary")


def _end_nodes(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, vertex, n): the end nodes of all trees, of 2 vertices at least;
    and (vertex, small): the trees, as bits, in which its first node is small."""

    def counted(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").withColumn("_n", F.col("n"))
        return join_keys(rows, sizes, ["node"], "vertex")

    root = vertices.select("vertex", F.posexplode("sketch").alias("tree", "value")).select("tree", "vertex", F.xxhash64("tree", "value").alias("node"))
    level, n_large = _level(counted(root))
    ends = level.where(F.col("n") <= SMALL)
    small = ends.groupBy("vertex").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("small"))
    large = level.where(F.col("n") > SMALL)
    for depth in range(DEPTH):
        if not n_large:
            break
        if depth == DEPTH - 1:
            ends = ends.unionByName(large)
            break
        # two of four positions that this tree and depth alone use, so trees part a pair independently
        paths = vertices.select("vertex", F.slice("paths", 1 + TREES * CHOICE * depth, TREES * CHOICE).alias("paths"))
        pick = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(CHOICE))
        other = (pick + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(CHOICE - 1))) % CHOICE
        first, second = ((CHOICE * F.col("tree") + x).cast("int") for x in (pick, other))
        branched = large.join(paths, "vertex").select("tree", "node", "n", "vertex", F.explode(F.array(F.struct(first.alias("p"), F.get("paths", first).alias("v")), F.struct(second.alias("p"), F.get("paths", second).alias("v")))).alias("c")).select("tree", "node", "n", "vertex", F.xxhash64("node", "c.p", "c.v").alias("child"))
        branched = cut(branched, ROWS)
        sizes = branched.groupBy("node", "n", "child").agg(F.count("*").alias("k"))
        alike, seen = measured_keys(sizes.groupBy("node", "n").agg(F.max("k").alias("most")).where(F.col("most") >= ALIKE * F.col("n")).select("node", F.col("n").alias("_n")))
        ends = ends.unionByName(cut(join_keys(large, alike, ["node"], "vertex", "left_semi", seen), ROWS))
        children = join_keys(branched, alike, ["node"], "vertex", "left_anti", seen).select("tree", "vertex", F.col("child").alias("node"))
        level, n_large = _level(counted(children))
        ends = ends.unionByName(level.where(F.col("n") <= SMALL))
        large = level.where(F.col("n") > SMALL)
    return ends, small


def _level(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of a level, written, and how many of them are in large nodes."""
    out, seen = measured(rows, n=F.count(F.lit(1)), large=F.count_if(F.col("n") > SMALL))
    return out.coalesce(seen["n"] // ROWS + 1), seen["large"]


def _blocks(ends: DataFrame, sketches: DataFrame) -> DataFrame:
    """(tree, node, block, n, vertex, ...): blocks of a bounded expected size.

    Every block of a large node also holds the pivot, its smallest vertex, which
    meets its sketch before it is copied to the blocks.
    """
    blocks = F.ceil(F.col("n") / SMALL).cast("int")
    dealt = ends.select("tree", "node", "n", F.pmod(F.xxhash64("node", "vertex"), blocks).cast("int").alias("block"), "vertex").join(sketches, "vertex")
    pivots = ends.where(F.col("n") > SMALL).groupBy("tree", "node", "n").agg(F.min("vertex").alias("vertex")).join(sketches, "vertex")
    return dealt.unionByName(pivots.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (node, block), from batches sorted by both."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not len(rows):
            continue
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (block[1:] != block[:-1])])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(int(starts[-1]))
    if held is not None and len(held):
        yield held


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "block").sortWithinPartitions("node", "block")


def _likely(group: pa.Table, least: int) -> tuple[list[bytes], np.ndarray, list[int]]:
    """The vertices, sorted; which have alike sketches; and a row of each."""
    names = group["vertex"].to_pylist()
    first = {v: i for i, v in enumerate(names)}  # a pivot may be there twice
    order = sorted(first)
    rows = [first[v] for v in order]
    values = np.frombuffer(b"".join(group["fine"].to_pylist()), np.uint8).reshape(-1, FINE)[rows]
    equal = np.stack([np.count_nonzero(values == row, axis=1) for row in values]) >= least
    np.fill_diagonal(equal, False)
    return order, equal, rows


def _open_pairs(group: pa.Table, least: int) -> tuple[list[bytes], np.ndarray, list[int]]:
    """Likely pairs in different components that no earlier small node holds."""
    names, alike, rows = _likely(group, least)
    labels = group["label"].to_pylist()
    code = np.unique([labels[i] for i in rows], return_inverse=True)[1]
    alike &= code[:, None] != code
    tree = group["tree"][0].as_py()
    if tree and alike.any():
        values = group["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)[rows]
        small = np.array(group["small"].to_pylist(), np.int64)[rows]
        for r in range(tree):
            alike &= ~((values[:, None, r] == values[:, r]) & ((small >> r & 1) == 1)[:, None])
    return names, alike, rows


def _parents(blocks: DataFrame, least: int) -> DataFrame:
    """(a, b): b's smallest likely partner a on a path from its block's first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for group in _groups(batches):
            names, alike, _ = _likely(group, least)
            left = alike.any(axis=1)
            for i in range(len(names)):
                queue = [i] if left[i] else []
                left[i] = False
                for x in queue:
                    near = np.flatnonzero(alike[x] & left)
                    left[near] = False
                    queue += near.tolist()
                    out[0].extend([names[x]] * len(near))
                    out[1].extend(names[k] for k in near)
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])

    found = _by_block(blocks.select("node", "block", "vertex", "fine")).mapInArrow(work, "a binary, b binary")
    return found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


_CARRIED = ["tree", "node", "block", "vertex", "sketch", "fine", "small", "label"]


def _apart(groups: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """The rows of vertices that have an open pair in their group."""
    named = groups.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex")).select(*_CARRIED)
    schema = named.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if len(set(group["label"].to_pylist())) > 1:
                _, alike, rows = _open_pairs(group, least)
                some = np.array(rows)[alike.any(axis=0) | alike.any(axis=1)]
                if len(some):
                    yield from group.take(pa.array(some)).combine_chunks().to_batches()

    return _by_block(named).mapInArrow(work, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, full): the full sets of the wanted vertices, once each.

    ``wanted`` holds (row, vertex) with one row for each vertex, and so one
    text for each; they are broadcast while few and shuffled beyond that.
    """
    ids, seen = measured(wanted.select("row").distinct(), n=F.count(F.lit(1)))
    ids = F.broadcast(ids) if seen["n"] <= BROADCAST_VERTICES else ids
    texts = docs.select("row", "text").join(ids, "row", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in batch.column(1).to_pylist() if len(x := shingles(t))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_vertex, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["vertex", "full"])

    # a row's name may come with several texts, and so with sets that nobody wants
    return texts.mapInArrow(work, "vertex binary, full binary").dropDuplicates(["vertex"])


def _confirmed(edges: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) that hold on full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (2, 3))
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = edges.join(full.withColumnsRenamed({"vertex": "b", "full": "full_b"}), "b").join(full.withColumnsRenamed({"vertex": "a", "full": "full_a"}), "a")
    return both.select("a", "b", "full_a", "full_b").mapInArrow(work, "a binary, b binary")


def _confirmed_in_place(rows: DataFrame, full: DataFrame, percent: int, least: int) -> DataFrame:
    """Links (a, b) on full sets that join components, group by group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            names, alike, rows = _open_pairs(group, least)
            content = group["full"].to_pylist()
            content = [np.frombuffer(content[i], np.uint64) for i in rows]
            labels = group["label"].to_pylist()
            above = {labels[i]: labels[i] for i in rows}

            def top(x: bytes, above: dict = above) -> bytes:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            good = []
            for i, j in np.argwhere(np.triu(alike | alike.T)).tolist():
                x, y = top(labels[rows[i]]), top(labels[rows[j]])
                if x != y and similar(content[i], content[j], percent):
                    above[x] = y
                    good.append((names[i], names[j]))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*good, strict=True)], ["a", "b"])

    return _by_block(rows.join(full, "vertex").select(*_CARRIED, "full")).mapInArrow(work, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex of each connected component.

    Large and small stars in turn, each an aggregate and a join on one end; the
    edges of a vertex that very many others hang on are dealt to many tasks.
    """
    edges, state = measured(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n=F.count(F.lit(1)))
    known = None
    while True:
        edges = edges.coalesce(state["n"] // ROWS + 1)
        tasks = edges.rdd.getNumPartitions() * 2
        few = state["n"] <= FEW_EDGES  # then no vertex can have many
        meet = (lambda x, y: x.join(y.drop("_n"), "u")) if few else (lambda x, y: join_keys(x, y, ["u"], "v"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = meet(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        large = large if few else cut(large, ROWS)
        joined = meet(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))).coalesce(tasks)
        edges, state = measured(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks), n=F.count(F.lit(1)), mix=F.bit_xor(F.xxhash64("u", "v")), mix2=F.bit_xor(F.xxhash64("v", "u", F.lit(1))))
        if state == known:
            break
        known = state
    edges = edges.coalesce(state["n"] // ROWS + 1)
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("vertex"), "label").unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())


def _tiles(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups that bring vertices outside a large node's main component to all others."""
    large = cut(blocks.where(F.col("n") > SMALL).dropDuplicates(["node", "vertex"]).join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex")), ROWS)
    share = large.groupBy("node", "label").agg(F.count("*").alias("k"))
    main = share.groupBy("node").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("parts"), F.sum("k").alias("_n")).where("parts > 1").select("node", F.col("m.label").alias("main"), "_n")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    large = join_keys(large, main, ["node"], "vertex").withColumn("tile", F.pmod(F.xxhash64("vertex"), tiles).cast("int"))
    stray = large.where(F.col("label") != F.col("main"))
    key = ["tree", F.xxhash64("node", "with").alias("node"), "block", "vertex", "sketch", "fine", "small"]
    strays = stray.groupBy("node").agg(F.collect_set("tile").alias("withs"), F.max("n").alias("_n"))  # numbers of tiles
    there = join_keys(large, strays, ["node"], "vertex").withColumn("with", F.explode("withs")).where(F.col("tile") != F.col("with")).withColumn("block", F.col("tile")).select(*key)
    # a stray of the tile itself meets its neighbours in the tile's own group
    here = stray.withColumn("with", F.col("tile")).withColumn("block", F.explode(F.sequence(F.lit(0), tiles - 1))).where(F.col("block") != F.col("with")).select(*key)
    own = large.join(stray.select("node", "tile").distinct(), ["node", "tile"], "left_semi").withColumn("with", F.col("tile")).withColumn("block", F.col("tile")).select(*key)
    return there.unionByName(here).unionByName(own)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (row, text, other columns) with n_shingles and ``label``.

    Rows of one component have one label; it is null for texts without words and
    for null ``row``, which belong to none. ``row`` names rows; where two texts
    share a name nothing is lost. The text is not among the columns.
    """
    percent = round(100 * threshold)
    least = math.floor(FINE * (threshold - ALLOWED * math.sqrt(threshold * (1 - threshold) / FINE)))
    rows = cut(sets(docs), ROWS)
    known = rows.where("vertex is not null and row is not null")
    vertices = cut(known.groupBy("vertex").agg(F.min_by(F.struct("row", "sketch", "paths", "fine"), "row").alias("s"), F.count("*").alias("_n")).select("vertex", "_n", "s.*"), ROWS)
    ends, small = _end_nodes(vertices)
    # every step is written, so that no plan grows with the steps before it
    sketches = cut(vertices.select("vertex", "sketch", "fine").join(small, "vertex", "left").withColumn("small", F.coalesce("small", F.lit(0))), ROWS)
    blocks = cut(_blocks(ends, sketches), ROWS)
    edges = cut(_parents(blocks, least), ROWS)
    places = vertices.select("row", "vertex")
    full = cut(_full_sets(docs, places.join(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "vertex", "left_semi")), FULL_ROWS)
    good = cut(_confirmed(edges, full, percent), ROWS)
    labels = cut(components(good), ROWS)
    for groups in (lambda: blocks.where(F.col("n") <= SMALL), lambda: _tiles(blocks, labels)):
        open_, seen = measured(_apart(groups(), labels, least), n=F.count(F.lit(1)))
        if seen["n"]:
            open_ = open_.coalesce(seen["n"] // ROWS + 1)
            more = places.join(open_.select("vertex").distinct().join(full, "vertex", "left_anti"), "vertex", "left_semi")
            if not more.isEmpty():  # likely partners that only a tile brought together
                full = cut(full.unionByName(_full_sets(docs, more)).dropDuplicates(["vertex"]), FULL_ROWS)
            good = cut(good.unionByName(_confirmed_in_place(open_, full, percent, least)), ROWS)
            labels = cut(components(good), ROWS)
    named = vertices.select("vertex", "_n").join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    out = rows.select(*(c for c in docs.columns if c != "text"), "n_shingles", F.when(F.col("row").isNotNull(), F.col("vertex")).alias("vertex"))
    joined = join_keys(out.where("vertex is not null"), named, ["vertex"], "row")
    return joined.unionByName(out.where("vertex is null").withColumn("label", F.lit(None).cast("binary"))).drop("vertex")


def mark(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = cut(classes(docs.select(F.col("doc_id").alias("row"), "text"), threshold), ROWS)
    smallest = rows.where("label is not null").groupBy("label").agg(F.min("row").alias("component_id"), F.count("*").alias("_n")).where("_n > 1")
    of = join_keys(rows.where("label is not null"), smallest, ["label"], "row", "left")
    out = of.unionByName(rows.where("label is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select(F.col("row").alias("doc_id"), "n_shingles", F.coalesce("component_id", "row").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
