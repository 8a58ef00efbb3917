"""Defect lists of all forms, results with a status, exact medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridloom.operators import defects, results


def rows(spark, text, nested=None):
    found = defects.defect_rows(spark.createDataFrame([("p", text), ("none", None)], "path string, content string"), nested)
    return [(r["values"], r.image_file) for r in found.orderBy("rec_no").collect()]


def test_rows_that_wrap(spark):
    text = "DefectRecordSpec 3 ID X Y ;\nDefectList\n1 2.5\n 3.5\n2 4 5\n3 6\n\n 7 more \"and; more\"\n4 8;\nSummarySpec 1 A ;\nSummaryList\n 9 ;\nEndOfFile;"
    assert [v for v, _ in rows(spark, text)] == [{"ID": "1", "X": "2.5", "Y": "3.5"}, {"ID": "2", "X": "4", "Y": "5"}, {"ID": "3", "X": "6", "Y": "7", "_extra_1": "more", "_extra_2": '"and; more"'}, {"ID": "4", "X": "8"}]


def test_flat_form_with_its_own_columns(spark):
    text = 'DefectList 3 DEFECTID XREL IMAGELIST\nData 2\n1 1000 Image 1 { "a;b.tif" } ;\n2\n 7 0\n;\nEndOfList\n'
    assert rows(spark, text) == [({"DEFECTID": "1", "XREL": "1000", "IMAGELIST": 'Image 1 { "a;b.tif" }'}, "a;b.tif"), ({"DEFECTID": "2", "XREL": "7", "IMAGELIST": "0"}, None)]


def test_nested_form_with_marks_in_quotes(spark):
    text = 'RECORD fileRecord "1.8" {\nList DefectList {\nColumns 2 { int32 ID, ImageList IMAGEINFO }\nData 2 {\n1 Images 2 { "a;b}.tif" "T", "c,d.tif" "T" } ;\n2 0 "x;y" ;\n3 0 ;\n}\n}\n}'
    assert rows(spark, text) == [({"ID": "1", "IMAGEINFO": 'Images 2 { "a;b}.tif" "T", "c,d.tif" "T" }'}, "a;b}.tif"), ({"ID": "2", "IMAGEINFO": "0", "_extra_1": '"x;y"'}, None)]
    entries = spark.createDataFrame([('Images 2 { "a;b}.tif" "T", "c,d.tif" "T" }', 2)], "t string, n int").select(defects.braced_entries("t", F.col("n")).alias("e")).first().e
    assert entries == [['"a;b}.tif"', '"T"'], ['"c,d.tif"', '"T"']]


def test_falls_back_to_flat(spark):
    text = "record filerecord broken\nDefectRecordSpec 1 ID ;\nDefectList\n1\n2;\nEndOfFile;"
    assert [v for v, _ in rows(spark, text)] == [{"ID": "1"}, {"ID": "2"}]


def test_odd_texts(spark):
    for text in ("", "\n", "DefectList", "DefectList\n", "DefectList\n;", "Columns 2 {", "Record FileRecord\nColumns 1 { int ID }\nData x { 1 ; }", 'DefectList 1 A\n"open ;'):
        assert rows(spark, text) in ([], [({"A": "open"}, None)]), text
    many = "DefectRecordSpec 2 ID X ;\nDefectList\n" + "\n".join(f"{k} {k}" for k in range(30_000)) + ";"
    assert len(rows(spark, many)) == 30_000


def test_a_failed_run_replaces_nothing_good(spark):
    old = spark.createDataFrame([(1, 1.0, 1.0, 0.9), (2, 2.0, 2.0, 0.2), (3, 3.0, 3.0, 0.3)], "image_id long, dx_nm double, dy_nm double, score double")
    run = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "flat"), (2, 5.0, 5.0, 0.8, "ok"), (4, 0.0, 0.0, 0.0, "no-scale")], "image_id long, dx_nm double, dy_nm double, score double, status string")
    better = {r.image_id: (r.score, r.kept) for r in results.keep_better(old, run).collect()}
    assert better == {1: (0.9, "old"), 2: (0.8, "new"), 3: (0.3, "old")}
    assert {r.image_id: r.score for r in results.apply_run(old, run).collect()} == {2: 0.8, 3: 0.3}


@pytest.mark.parametrize("least", [1, 7, 10**6])
def test_medians(spark, least):
    rnd = random.Random(least)
    data = []
    for group, n in (("a", 401), ("b", 2), ("c", 1), (None, 50), ("same", 60), ("far", 40), ("nulls", 3)):
        for _ in range(n):
            v = {"same": 4.0, "far": rnd.choice([-1e300, 1e300, 1e-300, 5.0]), "nulls": None}.get(group, rnd.gauss(0, 10))
            data.append((group, v, float(rnd.randint(0, 3))))
    df = spark.createDataFrame(data, "g string, v double, w double")
    found = {r.g: (r.v, r.w) for r in results.exact_medians(df, "g", ["v", "w"], least).collect()}
    for g in {x[0] for x in data}:
        vs, ws = ([x[k] for x in data if x[0] == g and x[k] is not None] for k in (1, 2))
        assert found[g] == (statistics.median(vs) if vs else None, statistics.median(ws)), g
