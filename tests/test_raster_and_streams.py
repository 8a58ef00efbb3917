"""Rasters and matching in closed form; streams against batch results."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import raster
from gridloom.operators import alignment, defects, hierarchy, repetition
from gridloom.operators import layer_algebra as L
from gridloom.plans import layout
from gridloom.sources.adapters import view
from gridloom.streaming import live

SF = "/root/testdata/sf0.001"


def test_mask_and_labels():
    m = raster.mask(np.array([[0, 0, 20, 10.0]]), 0, 0, 10, 5, 5)
    assert m.sum() == 6 and m[4, 0] and m[3, 2] and not m[2].any()
    out = raster.labels(np.array([[0, 0, 20, 20.0], [10, 10, 30, 30.0]]), np.array([1, 2]), 0, 0, 10, 5, 5)
    assert (out == 2).sum() == 9 and (out == 1).sum() == 5


def test_moves_of_stacks_pixel_by_pixel():
    stack = np.random.default_rng(8).random((3, 9, 11)) < 0.2
    for axis in "WH":
        got = raster.spread(stack, 2, axis)
        for k, r, c in np.ndindex(*stack.shape):
            near = stack[k, r, max(0, c - 2) : c + 3] if axis == "W" else stack[k, max(0, r - 2) : r + 3, c]
            assert got[k, r, c] == near.any()
        assert (raster.spread(stack[1], 2, axis) == got[1]).all()
    assert raster.moves(L.parse("(A > W:50) & ((B < H:25) > W:50)")[1], 25) == 3


@pytest.mark.parametrize("formula", ("A & B", "~A", "(A > W:75) - B", "~(A | B) < H:50", "((A > H:50) < W:25) | B"))
def test_formulas_on_pixels_of_one_wide_plane(spark, formula):
    rng = np.random.default_rng(11)
    rows = [(int(k), 0, int(x), int(y), int(x + w), int(y + h)) for k, x, y, w, h in zip(rng.integers(1, 3, 150), rng.integers(0, 4000, 150), rng.integers(0, 4000, 150), rng.integers(20, 500, 150), rng.integers(20, 500, 150))]
    shapes = spark.createDataFrame(rows, "layer int, datatype int, x1 long, y1 long, x2 long, y2 long")
    centres = [(1, 1000, 1000), (2, 2500, 1500), (3, 2000, 2500), (4, 90000, 90000)]
    images = spark.createDataFrame(centres, "image_id long, cx long, cy long")
    got = {r.image_id: r.n_pixels for r in alignment.formula_pixels(images, shapes, formula, {"A": (1, 0), "B": (2, 0), "unused": (9, 9)}, 1000, 40).collect()}
    boxes, layer = np.array([r[2:] for r in rows], float), np.array([r[0] for r in rows])
    planes = {n: raster.mask(boxes[layer == k], -1000, -1000, 25, 240, 240) for n, k in (("A", 1), ("B", 2))}
    whole = raster.evaluate(L.parse(formula)[1], planes, 25)
    for i, cx, cy in centres[:3]:
        c, r = (cx - 500 + 1000) // 25, 240 - (cy + 500 + 1000) // 25
        assert got[i] == whole[r : r + 40, c : c + 40].sum()
    assert got[4] == (1600 if formula.startswith("~") else 0)


def test_formulas_on_pixels_name_layers(spark):
    with pytest.raises(ValueError, match="unknown names: Z"):
        alignment.formula_pixels(spark.range(1), spark.range(1), "A & Z", {"A": (1, 0)}, 1000, 40)


def test_match_finds_a_shift():
    rng = np.random.default_rng(1)
    template = raster.blurred(rng.random((80, 80)) > 0.7, 1.5)
    image = np.roll(template, (3, 4), axis=(0, 1))
    dx, dy, score = raster.match(image, template, 8, 5.0)
    assert abs(dx + 20) < 0.5 and abs(dy - 15) < 0.5 and score > 0.99
    assert raster.match(np.ones((20, 20)), np.ones((20, 20)), 4, 5.0) == (0, 0, 0)
    assert raster.peak_offset(0.2, 0.9, 0.2) == 0 and raster.peak_offset(0.2, 0.2, 0.2) == 0


def test_matches_recover_the_stored_offsets(spark):
    got = layout.QUERIES["aln_03_match"](spark, SF).join(view(spark, SF, "refined").withColumnsRenamed({"score": "old"}).select("image_id", F.col("dx_nm").alias("rx"), F.col("dy_nm").alias("ry")), "image_id").collect()
    good = [abs(r.dx_nm + 12 * r.rx) < 20 and abs(r.dy_nm + 12 * r.ry) < 20 for r in got if r.status == "ok"]
    assert len(good) > 100 and np.mean(good) > 0.9


def test_levels_equal_a_recursive_query(spark):
    placement = view(spark, SF, "placement")
    placed = hierarchy.instances(placement, 0).groupBy("cell_id").count().withColumnRenamed("count", "n")
    sql = spark.sql("WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS cell_id UNION ALL SELECT child FROM w JOIN {p} ON cell_id = parent) SELECT cell_id, count(*) AS n FROM w GROUP BY cell_id", p=placement)
    assert placed.exceptAll(sql).isEmpty() and sql.exceptAll(placed).isEmpty()


def test_cycles_and_unknown_cells_end(spark):
    p = spark.createDataFrame([(0, 1, 0, 0, 0, False), (1, 0, 5, 5, 0, False), (1, 9, 1, 1, 1, True)], "parent long, child long, x long, y long, q int, flip boolean")
    assert sorted(r.cell_id for r in hierarchy.instances(p, 0).collect()) == [0, 1, 9]


def test_running_offsets(spark):
    row = spark.createDataFrame([([3, 4, -2],)], "gaps array<long>").select(repetition.running("gaps").alias("o")).first()
    assert row.o == [0, 3, 7, 5]


def test_defect_list_text(spark):
    text = "FileVersion 1 2;\nDiePitch 100.5 200;\nDefectRecordSpec 2 DEFECTID XREL ;\nDefectList\n1 2.5\n2 x extra\n;\nEndOfFile;"
    files = spark.createDataFrame([("a", text), ("b", "DiePitch 2 { 5000, 7000 }"), ("c", "")], "path string, content string")
    rows = [r["values"] for r in defects.parse_defects(files).orderBy("rec_no").collect()]
    assert rows == [{"DEFECTID": "1", "XREL": "2.5"}, {"DEFECTID": "2", "XREL": "x", "_extra_1": "extra"}]
    pitch = {r.path: (r.pitch_x_nm, r.pitch_y_nm) for r in defects.die_pitch(files).collect()}
    assert pitch == {"a": (100500.0, 200000.0), "b": (5000.0, 7000.0), "c": (None, None)}


@pytest.fixture
def stream(spark, tmp_path):
    view(spark, SF, "perf_events").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_live_totals_equal_batch(spark, stream):
    got = run(live.by_operation(stream), "complete", "ops")
    assert got.exceptAll(live.by_operation(view(spark, SF, "perf_events"))).isEmpty()
    windows = run(live.by_window(stream, late="60 days"), "update", "wins")
    assert windows.agg(F.max("n")).first()[0] >= 1
    assert run(live.sessions(stream, late="60 days"), "append", "sess").columns == ["start", "op", "n"]


def test_live_results_only_get_better(spark, tmp_path):
    rows = view(spark, SF, "refined").unionByName(view(spark, SF, "rerun"))
    rows.repartition(2).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    got = run(live.keep_better(stream), "append", "better").groupBy("image_id").agg(F.max("score").alias("s"))
    best = rows.where("score is not null").groupBy("image_id").agg(F.max("score").alias("s"))
    assert got.exceptAll(best).isEmpty() and best.exceptAll(got).isEmpty()


def test_better_results_of_many_images_share_few_states(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, best, expected = [], {}, []
    for part in range(3):
        kind = "image_id long, dx_nm double, dy_nm double, score double"
        fresh = [(None if i == 7 else int(i), float(part), float(i), None if s == 3 else float(s)) for i, s in zip(rng.permutation(5000), rng.integers(-5, 5, 5000))]
        rows.append(spark.createDataFrame(fresh, kind))
        for i, x, y, s in fresh:
            if s is not None and s > best.get(i, float("-inf")):
                best[i] = s
                expected.append((i, x, y, s))
    for part, more in enumerate(rows):
        more.coalesce(1).write.parquet(str(tmp_path / f"r/part={part}"))
    stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "r/*"))
    order = lambda found: sorted(((r[0] is None, *(r if r[0] is not None else (0, *r[1:]))) for r in found))
    parts = live.in_parts(rows, lambda stream: live.keep_better(stream, buckets=16))
    assert order(tuple(r) for r in parts.collect()) == order(expected)
    for name, forget in (("all_better", None), ("some_better", "7 days")):
        q = live.keep_better(stream(), forget, 16).writeStream.outputMode("append").format("memory").queryName(name).start()
        found, until = {}, time.time() + 90
        while found != best and time.time() < until:  # with a time to forget a stream is never idle
            time.sleep(0.5)
            found = {r.image_id: r.s for r in spark.table(name).groupBy("image_id").agg(F.max("score").alias("s")).collect()}
            states = max((s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]), default=0)
        q.stop()
        assert found == best
        assert states <= 16 + 1


def test_page_map_falls_back_to_file_order(spark):
    rows = lambda *ids: spark.createDataFrame([(i, i, list(x)) for i, x in enumerate(ids)], "image_id long, rec_no long, ids array<long>")
    got = lambda df, n: sorted((r.image_id, r.page, r.mode) for r in defects.page_map(df, F.lit(n)).collect())
    assert got(rows([0], [2, 1]), 3) == [(0, 0, "imagelist"), (1, 1, "imagelist"), (1, 2, "imagelist")]
    assert got(rows([1], [3]), 3) == [(0, 0, "imagelist"), (1, 2, "imagelist")]
    assert got(rows([5], [], [7, 9]), 3) == [(0, 0, "sequential"), (2, 1, "sequential"), (2, 2, "sequential")]
    assert got(rows([1], [1]), 3) == [(0, 0, "sequential"), (1, 1, "sequential")]


def test_nested_defect_lists(spark):
    text = 'Record A "1.8" {\nList DefectList {\nColumns 2 { int32 ID, ImageList IMG }\nData 2 {\n1\n Images 1 { "a b.tif" "T" 1 "x" } ;\n2 0 9 ;\n}\n}\n}'
    rows = defects.parse_nested(spark.createDataFrame([("p", text), ("q", "")], "path string, content string")).orderBy("rec_no").collect()
    assert [(r["values"]["ID"], r.image_file) for r in rows] == [("1", "a b.tif"), ("2", None)]
    assert rows[1]["values"]["_extra_1"] == "9"


@pytest.mark.parametrize("layers", [3, 40])
def test_topmost_ids_equal_painting(layers):
    rng = np.random.default_rng(layers)
    low = rng.integers(-40, 200, (150, 2))
    b = np.concatenate([low, low + rng.integers(0, 90, (150, 2))], axis=1).astype(float)
    ids, plane = rng.integers(-1, layers - 1, 150), rng.integers(0, 4, 150)
    known, top = raster.top_planes(b, ids, plane, 5, 0, 0, 10.0, 20, 24)
    assert not top[4].any() and known.tolist() == sorted(set(ids.tolist()))
    for k in range(4):
        painted = np.zeros((20, 24), int)
        for i, label in enumerate(known):
            own = b[(ids == label) & (plane == k)]
            if len(own):
                painted[raster.mask(own, 0, 0, 10.0, 20, 24)] = i + 1
        assert (top[k] == painted).all()


def test_label_counts_of_layer_zero(spark):
    seen = spark.createDataFrame([(1, 50, 50, 0, 0, 0, 49, 49), (1, 50, 50, 4, 0, 0, 19, 19), (2, 50, 50, 0, 70, 70, 99, 99)], "image_id long, cx long, cy long, layer int, x1 long, y1 long, x2 long, y2 long")
    assert sorted(map(tuple, alignment.label_counts(seen, 100, 100).collect())) == [(1, 0, 50 * 50 - 400), (1, 4, 400), (2, 0, 900)]


def test_correlation_is_that_of_every_place():
    rng = np.random.default_rng(3)
    image, template = rng.random((2, 11, 14)), rng.random((2, 4, 6))
    found = raster.correlation(image, template)
    assert found.shape == (2, 8, 9)
    for k, r, c in np.ndindex(*found.shape):
        a, b = image[k, r : r + 4, c : c + 6], template[k]
        assert abs(found[k, r, c] - np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 1e-9


def test_drift_is_read_with_the_field(spark):
    images = spark.createDataFrame([(1, 100, 100, 5.0, -5.0), (2, 100, 100, 7.0, 0.0)], "image_id long, cx long, cy long, ox double, oy double")
    shapes = spark.createDataFrame([(10, 90, 90, 110, 110)], "layer int, x1 long, y1 long, x2 long, y2 long")
    seen = alignment.in_view(shapes, images, 100, "ox", "oy")
    assert sorted((r.image_id, r.ox, r.oy, r.layer) for r in seen.collect()) == [(1, 5.0, -5.0, 10), (2, 7.0, 0.0, 10)]
