"""Queries over images, match results, defect lists and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import defects, ordered, results
from gridloom.sources.adapters import live_view, view, with_views
from gridloom.streaming import live

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


@query("prj_01_to_layout", with_views("SELECT image_id, xrel - 1000 AS gx, -yrel - 2000 AS gy FROM images", "images"))
def _(spark: SparkSession, d: str) -> DataFrame:
    gx, gy = G.to_layout("xrel", "yrel", 1000, 2000, negate_y=True)
    return view(spark, d, "images").select("image_id", gx.alias("gx"), gy.alias("gy"))


@query("prj_02_die_corner", "SELECT s_suppkey AS chip_id, (CAST(s_suppkey % 30 AS DOUBLE) / 2 + s_nationkey - CAST(s_suppkey % 11 AS DOUBLE) / 2) * 1e6 AS corner_nm FROM supplier")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 30).cast("double").alias("die"), F.col("s_nationkey").alias("centre"), (F.col("s_suppkey") % 11).cast("double").alias("chip"))
    return rows.select(F.col("s_suppkey").alias("chip_id"), G.corner_from_die("die", "centre", "chip").alias("corner_nm"))


@query("prj_03_chip_corner", with_views("SELECT part_id, chip_id, (chip_x_um - gds_off_x_um) * 1000.0 AS corner_x_nm, (chip_y_um - gds_off_y_um) * 1000.0 AS corner_y_nm FROM chips", "chips"))
def _(spark, d):
    return view(spark, d, "chips").select("part_id", "chip_id", G.chip_corner("chip_x_um", "gds_off_x_um").alias("corner_x_nm"), G.chip_corner("chip_y_um", "gds_off_y_um").alias("corner_y_nm"))


@query("prj_04_coarse_anchor", with_views("SELECT image_id, CASE WHEN has_coords THEN xrel - 1000 + 25 END AS ax, CASE WHEN has_coords THEN yrel - 2000 - 40 END AS ay FROM images", "images"))
def _(spark, d):
    gx, gy = G.to_layout("xrel", "yrel", 1000, 2000)
    return view(spark, d, "images").select("image_id", F.when(F.col("has_coords"), gx + 25).alias("ax"), F.when(F.col("has_coords"), gy - 40).alias("ay"))


@query("prj_05_refined_anchor", with_views("SELECT i.image_id, xrel + coalesce(dx_nm, 0) AS ax, yrel + coalesce(dy_nm, 0) AS ay FROM images i LEFT JOIN refined r ON i.image_id = r.image_id", "images", "refined"))
def _(spark, d):
    joined = view(spark, d, "images").join(view(spark, d, "refined"), "image_id", "left")
    return joined.select("image_id", G.anchor("xrel", "dx_nm").alias("ax"), G.anchor("yrel", "dy_nm").alias("ay"))


@query("prj_06_field_of_view", with_views("SELECT image_id, xrel - 750e0 AS x1, xrel + 750e0 AS x2, yrel - 1500e0 AS roi_y1, yrel + 1500e0 AS roi_y2 FROM images", "images"))
def _(spark, d):
    (x1, x2), (y1, y2) = G.around("xrel", G.DEFAULT_FOV_NM), G.around("yrel", 2 * G.DEFAULT_FOV_NM)
    return view(spark, d, "images").select("image_id", x1.alias("x1"), x2.alias("x2"), y1.alias("roi_y1"), y2.alias("roi_y2"))


@query("prj_08_scale", with_views("SELECT i.image_id, CASE WHEN c.nm_per_px > 0 THEN c.nm_per_px ELSE c.fov_w_nm / greatest(1, i.width_px) END AS nm_per_px FROM images i JOIN chips c ON i.width_px = c.chip_id + 100", "images", "chips"))
def _(spark, d):
    chips = view(spark, d, "chips").withColumn("width_px", F.col("chip_id") + 100)
    return view(spark, d, "images").join(chips, "width_px").select("image_id", G.nm_per_px("nm_per_px", "fov_w_nm", "width_px").alias("nm_per_px"))


@query("prj_10_grid_to_nm", with_views("SELECT image_id, CAST(round_even(xrel * 0.25, 0) AS BIGINT) AS x_nm FROM images", "images"))
def _(spark, d):
    return view(spark, d, "images").select("image_id", G.grid_to_nm("xrel", 4000.0).alias("x_nm"))


@query("prj_13_pixels", with_views("SELECT image_id, CAST(round_even((xrel - 10) / 4.0, 0) AS BIGINT) AS col, CAST(round_even(999 - (yrel - 20) / 4.0, 0) AS BIGINT) AS row_no, 10 + CAST(round_even((xrel - 10) / 4.0, 0) AS BIGINT) * 4 AS back_nm FROM images", "images"))
def _(spark, d):
    rows = view(spark, d, "images").withColumns({"x0": F.lit(10), "y0": F.lit(20), "s": F.lit(4), "h": F.lit(1000)}).withColumn("col", G.to_pixel("xrel", "x0", "s"))
    return rows.select("image_id", "col", G.to_pixel("yrel", "y0", "s", "h").alias("row_no"), G.from_pixel("col", "x0", "s").alias("back_nm"))


@query("prj_16_page_for_ordinal", with_views("SELECT image_id, CASE WHEN n_pages > 0 THEN 10 + least(greatest(image_id % 6, 1), n_pages) END AS page FROM images", "images"))
def _(spark, d):
    rows = view(spark, d, "images").withColumn("pages", F.when(F.col("n_pages") > 0, F.sequence(F.lit(11), 10 + F.col("n_pages"))).otherwise(F.array().cast("array<bigint>")))
    return rows.select("image_id", G.page_for_ordinal(F.col("pages"), (F.col("image_id") % 6).cast("int")).alias("page"))


@query("prj_18_alignment_values", with_views("SELECT i.image_id, coalesce(c.fov_w_nm, 1500.0) AS fov_nm, coalesce((c.chip_x_um - c.gds_off_x_um) * 1000.0, 0.0) AS corner_x_nm, c.nm_per_px IS NULL AS auto_scale FROM images i LEFT JOIN chips c ON i.width_px = c.chip_id + 100", "images", "chips"))
def _(spark, d):
    chips = view(spark, d, "chips").withColumn("width_px", F.col("chip_id") + 100)
    joined = view(spark, d, "images").join(chips, "width_px", "left")
    return joined.select("image_id", F.coalesce("fov_w_nm", F.lit(G.DEFAULT_FOV_NM)).alias("fov_nm"), F.coalesce(G.chip_corner("chip_x_um", "gds_off_x_um"), F.lit(0.0)).alias("corner_x_nm"), F.col("nm_per_px").isNull().alias("auto_scale"))


@query("flt_07_score_gate", with_views("SELECT image_id, score FROM refined WHERE score >= 0.5", "refined"))
def _(spark, d):
    return view(spark, d, "refined").where(results.passes()).select("image_id", "score")


@query("flt_08_low_score", with_views("SELECT image_id, score FROM refined WHERE score < 0.5", "refined"))
def _(spark, d):
    return view(spark, d, "refined").where(results.low()).select("image_id", "score")


@query("flt_09_needs_align", with_views("SELECT image_id, rec_no FROM images WHERE has_coords AND image_id NOT IN (SELECT image_id FROM refined)", "images", "refined"))
def _(spark, d):
    return results.needs_run(view(spark, d, "images"), view(spark, d, "refined")).select("image_id", "rec_no")


@query("flt_10_subset", with_views("SELECT image_id, kind FROM images WHERE image_id IN (SELECT image_id FROM rerun)", "images", "rerun"))
def _(spark, d):
    return results.subset(view(spark, d, "images"), view(spark, d, "rerun")).select("image_id", "kind")


@query("flt_12_label_problems", with_views("SELECT id, layer, regexp_replace(layer, '[A-Za-z0-9_]', '', 'g') AS invalid_chars, regexp_matches(layer, '^[0-9]') AS leading_digit FROM label_map WHERE regexp_matches(layer, '[^A-Za-z0-9_]') OR regexp_matches(layer, '^[0-9]')", "label_map"))
def _(spark, d):
    return results.label_problems(view(spark, d, "label_map"))


@query("jon_08_image_pages", with_views("+placed AS (SELECT image_id, n_pages, coalesce(sum(n_pages) OVER (ORDER BY rec_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM images) SELECT image_id, CAST(unnest(range(CAST(p0 AS BIGINT), CAST(p0 + n_pages AS BIGINT))) AS BIGINT) AS page FROM placed", "images"))
def _(spark, d):
    return defects.sequential_pages(view(spark, d, "images"))


@query("win_02_row_ids", with_views("SELECT image_id, row_number() OVER (ORDER BY rec_no) AS row_id FROM images", "images"))
def _(spark, d):
    return defects.row_ids(view(spark, d, "images"), "rec_no").select("image_id", "row_id")


@query("agg_07_score_histogram", with_views("+every AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)), c AS (SELECT CAST(least(greatest(floor(score * 20), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM refined WHERE score IS NOT NULL GROUP BY 1) SELECT every.bin, coalesce(n, 0) AS n FROM every LEFT JOIN c ON every.bin = c.bin", "refined"))
def _(spark, d):
    return results.histogram(view(spark, d, "refined"), 20)


@query("agg_08_residual_median", with_views("SELECT kind, median(dx_nm) AS dx, median(dy_nm) AS dy, round(median(sqrt(dx_nm * dx_nm + dy_nm * dy_nm)), 6) AS length FROM images i JOIN refined r ON i.image_id = r.image_id WHERE score >= 0.5 GROUP BY kind", "images", "refined"))
def _(spark, d):
    good = view(spark, d, "images").join(view(spark, d, "refined").where(results.passes()), "image_id")
    return results.medians(good, "kind")


@query("agg_09_perf", with_views("SELECT op, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us, min(seq) AS first_seq, max_by(us, seq) AS last_us, max_by(label, seq) AS last_label, max_by(level, seq) AS last_level, round(sum(us) / count(*), 3) AS avg_us, split_part(op, ':', 1) AS category FROM perf_events GROUP BY op", "perf_events"))
def _(spark, d):
    return results.perf_summary(view(spark, d, "perf_events"))


@query("agg_11_duplicate_labels", with_views("SELECT layer, count(DISTINCT id) AS n_ids, min(id) AS first_id FROM label_map GROUP BY layer HAVING count(DISTINCT id) > 1", "label_map"))
def _(spark, d):
    return results.duplicate_labels(view(spark, d, "label_map"))


@query("agg_12_image_total", with_views("SELECT kind, CAST(sum(n_pages) AS BIGINT) AS n FROM images GROUP BY kind", "images"))
def _(spark, d):
    return view(spark, d, "images").groupBy("kind").agg(F.sum("n_pages").alias("n"))


@query("agg_13_majority", with_views("+c AS (SELECT kind, n_pages, count(*) AS n FROM images GROUP BY kind, n_pages) SELECT kind, max_by(n_pages, n * 100 - n_pages) AS n_pages, max(n) AS votes, sum(n) - max(n) <= greatest(1, floor(sum(n) * 0.1)) AS agreed FROM c GROUP BY kind", "images"))
def _(spark, d):
    counted = view(spark, d, "images").groupBy("kind", "n_pages").agg(F.count("*").alias("n"))
    return counted.groupBy("kind").agg(F.max_by("n_pages", F.struct("n", -F.col("n_pages"))).alias("n_pages"), F.max("n").alias("votes"), (F.sum("n") - F.max("n") <= F.greatest(F.lit(1), F.floor(F.sum("n") * 0.1))).alias("agreed"))


@query("agg_16_extent", with_views("SELECT min(xrel) - greatest(1e-1 * (max(xrel) - min(xrel)), 15e2, 1e3) AS x1, max(xrel) + greatest(1e-1 * (max(xrel) - min(xrel)), 15e2, 1e3) AS x2 FROM images WHERE has_coords", "images"))
def _(spark, d):
    pad = F.greatest(0.1 * (F.max("xrel") - F.min("xrel")), F.lit(G.DEFAULT_FOV_NM), F.lit(1000.0))
    return view(spark, d, "images").where("has_coords").agg((F.min("xrel") - pad).alias("x1"), (F.max("xrel") + pad).alias("x2"))


@query("agg_17_throughput", with_views("SELECT label, count(*) AS done, round(count(*) / (date_diff('second', min(ts), max(ts))), 9) AS per_s FROM perf_events GROUP BY label", "perf_events"))
def _(spark, d):
    return view(spark, d, "perf_events").groupBy("label").agg(F.count("*").alias("done"), F.round(F.count("*") / (F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))), 9).alias("per_s"))


@query("agg_19_time_share", with_views("SELECT CASE WHEN label IN ('view', 'click', 'error') THEN label ELSE 'other' END AS category, CAST(sum(us) AS BIGINT) AS us, round(sum(us) / (SELECT sum(us) FROM perf_events), 6) AS share FROM perf_events GROUP BY 1 ORDER BY us DESC, category LIMIT 12", "perf_events"))
def _(spark, d):
    return results.share_by_category(view(spark, d, "perf_events"), ["view", "click", "error"], 12)


@query("aln_05_status", with_views("SELECT i.image_id, CASE WHEN NOT has_coords THEN 'no-coords' WHEN score IS NULL THEN 'not-run' WHEN score >= 0.5 THEN 'ok' ELSE 'low-score' END AS status, score FROM images i LEFT JOIN refined r ON i.image_id = r.image_id", "images", "refined"))
def _(spark, d):
    return results.with_status(view(spark, d, "images"), view(spark, d, "refined")).select("image_id", "status", "score")


@query("aln_06_keep_better", with_views("+n AS (SELECT * FROM rerun WHERE score IS NOT NULL), j AS (SELECT coalesce(r.image_id, n.image_id) AS image_id, r.dx_nm AS ox, r.dy_nm AS oy, r.score AS os, n.dx_nm AS nx, n.dy_nm AS ny, n.score AS ns, n.score IS NOT NULL AND (r.score IS NULL OR n.score > r.score) AS better FROM refined r FULL JOIN n ON r.image_id = n.image_id) SELECT image_id, CASE WHEN better THEN nx ELSE ox END AS dx_nm, CASE WHEN better THEN ny ELSE oy END AS dy_nm, CASE WHEN better THEN ns ELSE os END AS score, CASE WHEN better THEN 'new' ELSE 'old' END AS kept FROM j", "refined", "rerun"))
def _(spark, d):
    return results.keep_better(view(spark, d, "refined"), view(spark, d, "rerun"))


@query("aln_08_alignment_rows", with_views("SELECT i.image_id, xrel, yrel, coalesce(CAST(round(dx_nm, 3) AS VARCHAR), '') AS dx, CASE WHEN score IS NULL THEN '' ELSE 'x' END AS has_score, coalesce(score, 0) AS s FROM images i LEFT JOIN refined r ON i.image_id = r.image_id", "images", "refined"))
def _(spark, d):
    joined = view(spark, d, "images").join(view(spark, d, "refined"), "image_id", "left")
    return joined.select("image_id", "xrel", "yrel", F.coalesce(F.round("dx_nm", 3).cast("string"), F.lit("")).alias("dx"), F.when(F.col("score").isNull(), "").otherwise("x").alias("has_score"), F.coalesce("score", F.lit(0.0)).alias("s"))


@query("aln_10_apply_run", with_views("SELECT image_id, dx_nm, dy_nm, score FROM refined WHERE image_id NOT IN (SELECT image_id FROM rerun) UNION ALL SELECT image_id, dx_nm, dy_nm, score FROM rerun WHERE score IS NOT NULL", "refined", "rerun"))
def _(spark, d):
    return results.apply_run(view(spark, d, "refined"), view(spark, d, "rerun"))


@query("aln_11_color_class", with_views("SELECT CASE WHEN score IS NULL THEN 'none' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS class, count(*) AS n FROM images i LEFT JOIN refined r ON i.image_id = r.image_id GROUP BY 1", "images", "refined"))
def _(spark, d):
    joined = view(spark, d, "images").join(view(spark, d, "refined"), "image_id", "left")
    return joined.groupBy(results.color_class().alias("class")).agg(F.count("*").alias("n"))


@query("srt_02_results_order", with_views("SELECT i.image_id, coalesce(score, -1) AS score_key, coalesce(dx_nm, 1e18) AS dx_key FROM images i LEFT JOIN refined r ON i.image_id = r.image_id ORDER BY score_key, dx_key, i.image_id", "images", "refined"))
def _(spark, d):
    joined = view(spark, d, "images").join(view(spark, d, "refined"), "image_id", "left")
    return joined.select("image_id", F.coalesce("score", F.lit(-1.0)).alias("score_key"), F.coalesce("dx_nm", F.lit(1e18)).alias("dx_key")).orderBy("score_key", "dx_key", "image_id")


@query("win_10_last_events", with_views("SELECT op, seq, us FROM (SELECT op, seq, us, row_number() OVER (PARTITION BY op ORDER BY seq DESC) AS k FROM perf_events) WHERE k <= 5", "perf_events"))
def _(spark, d):
    # the last five of each operation: arrays of five merge before the shuffle
    top = F.slice(F.sort_array(F.collect_list(F.struct("seq", "us")), asc=False), 1, 5)
    chunks = view(spark, d, "perf_events").groupBy("op", F.floor(F.col("seq") / 1000).alias("chunk")).agg(top.alias("t"))
    return chunks.groupBy("op").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t")), asc=False), 1, 5).alias("t")).select("op", F.inline("t"))


@query("win_03_byte_spans", with_views("SELECT cell_id, byte_offset, coalesce(lead(byte_offset) OVER (ORDER BY byte_offset), 1000000000000) - byte_offset AS byte_span FROM cell_index", "cell_index"))
def _(spark, d):
    return defects.byte_spans(view(spark, d, "cell_index"), 10**12).select("cell_id", "byte_offset", "byte_span")


@query("srt_01_giant_cells", with_views("SELECT cell_id, byte_span FROM (SELECT cell_id, coalesce(lead(byte_offset) OVER (ORDER BY byte_offset), 1000000000000) - byte_offset AS byte_span FROM cell_index) WHERE byte_span >= 5000 ORDER BY byte_span DESC, cell_id LIMIT 4", "cell_index"))
def _(spark, d):
    return defects.giant_cells(defects.byte_spans(view(spark, d, "cell_index"), 10**12), 5000, 4).select("cell_id", "byte_span")


@query("jon_06_layer_name", with_views("+k AS (SELECT DISTINCT layer, datatype FROM shapes), m AS (SELECT k.layer, k.datatype, n.name, row_number() OVER (PARTITION BY k.layer, k.datatype ORDER BY coalesce(l_hi, 2147483647) - l_lo, coalesce(d_hi, 2147483647) - d_lo, rec_no) AS r FROM k JOIN layer_names n ON k.layer BETWEEN l_lo AND coalesce(l_hi, 2147483647) AND k.datatype BETWEEN d_lo AND coalesce(d_hi, 2147483647) WHERE NOT (l_lo = 0 AND l_hi IS NULL)) SELECT k.layer, k.datatype, coalesce(m.name, '') AS name FROM k LEFT JOIN m ON k.layer = m.layer AND k.datatype = m.datatype AND m.r = 1", "shapes", "layer_names"))
def _(spark, d):
    return defects.layer_name(view(spark, d, "shapes"), view(spark, d, "layer_names"))


@query("jon_09_chip_lookup", with_views("SELECT n_name, count(*) AS n_chips, min(chip_id) AS first_chip FROM nation JOIN chips ON n_nationkey = part_id GROUP BY n_name", "chips"))
def _(spark, d):
    parts = spark.read.parquet(f"{d}/nation.parquet")
    return view(spark, d, "chips").join(parts, F.col("part_id") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_chips"), F.min("chip_id").alias("first_chip"))


@query("klarf_parse", with_views("SELECT 'lot' || CAST(kind AS VARCHAR) AS path, CAST(image_id AS VARCHAR) AS defect_id, CAST(CAST(xrel AS DOUBLE) * 1000 AS DOUBLE) AS x_nm FROM images", "images"))
def _(spark, d):
    """Defect lists rendered as text, one file for each 500 images of a kind, and read back; some rows go over two lines."""
    rows = view(spark, d, "images")
    gap = F.when(F.col("image_id") % 3 == 0, "\n  ").otherwise(" ")
    line = F.concat(F.concat_ws(" ", "image_id", "xrel"), gap, F.concat_ws(" ", "yrel", "n_pages", F.lit("spare")))
    head = F.lit("FileVersion 1 2;\nDefectRecordSpec 4 DEFECTID XREL YREL IMAGECOUNT ;\nDefectList\n")
    files = rows.groupBy("kind", F.floor(F.col("rec_no") / 500).alias("part")).agg(F.concat(head, F.array_join(F.collect_list(line), "\n"), F.lit(";\nEndOfFile;")).alias("content"))
    parsed = defects.parse_defects(files.select(F.concat(F.lit("lot"), "kind").alias("path"), "content"))
    return parsed.select("path", F.col("values")["DEFECTID"].alias("defect_id"), defects.position_nm(F.lit("1.2"), F.col("values")["XREL"]).alias("x_nm"))


@query("jon_10_last_seen", with_views("SELECT seq, op, last_value(CASE WHEN label = 'purchase' THEN seq END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS last_purchase FROM perf_events", "perf_events"))
def _(spark, d):
    return ordered.last_seen(view(spark, d, "perf_events"), "seq", F.when(F.col("label") == "purchase", F.col("seq")), "last_purchase").select("seq", "op", "last_purchase")


@query("jon_11_nearest", with_views("+q AS (SELECT s_suppkey AS query_id, (s_suppkey * 7717) % 100000 AS qx, (s_suppkey * 3331) % 100000 AS qy FROM supplier), m AS (SELECT query_id, image_id, (xrel - qx) * (xrel - qx) + (yrel - qy) * (yrel - qy) AS d2 FROM q JOIN images ON abs(xrel - qx) <= 900 AND abs(yrel - qy) <= 900) SELECT query_id, image_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, image_id DESC) AS k FROM m WHERE d2 <= 810000) WHERE k = 1", "images"))
def _(spark, d):
    spots = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("query_id"), ((F.col("s_suppkey") * 7717) % 100000).alias("qx"), ((F.col("s_suppkey") * 3331) % 100000).alias("qy"))
    points = view(spark, d, "images").select("image_id", F.col("xrel").alias("x"), F.col("yrel").alias("y"))
    return defects.nearest(points, spots, 900)


@query("jon_12_label_numbers", with_views("+l AS (SELECT layer, min(id) AS first_id FROM label_map GROUP BY layer) SELECT layer, row_number() OVER (ORDER BY first_id) AS n FROM l", "label_map"))
def _(spark, d):
    first = view(spark, d, "label_map").groupBy("layer").agg(F.min("id").alias("first_id"))
    return defects.row_ids(first, "first_id").select("layer", F.col("row_id").alias("n"))


@query("jon_13_sent_read", with_views("+a AS (SELECT kind, n_pages, count(*) AS sent FROM images GROUP BY kind, n_pages), b AS (SELECT kind, n_pages, count(*) AS read FROM images JOIN refined USING (image_id) GROUP BY kind, n_pages) SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.n_pages, b.n_pages) AS n_pages, coalesce(sent, 0) AS sent, coalesce(read, 0) AS read FROM a FULL JOIN b ON a.kind = b.kind AND a.n_pages = b.n_pages", "images", "refined"))
def _(spark, d):
    images = view(spark, d, "images")
    return defects.sent_and_read(images, images.join(view(spark, d, "refined").select("image_id"), "image_id"), ["kind", "n_pages"])


@query("flt_13_rows_with_images", with_views("SELECT image_id, n_pages FROM images WHERE n_pages > 0", "images"))
def _(spark, d):
    return view(spark, d, "images").where("n_pages > 0").select("image_id", "n_pages")


@query("flt_14_viewport", with_views("SELECT image_id FROM images WHERE xrel * 0.02e0 BETWEEN -8 AND 808 AND yrel * 0.02e0 BETWEEN -8 AND 608", "images"))
def _(spark, d):
    on_screen = (F.col("xrel") * 0.02).between(-8, 808) & (F.col("yrel") * 0.02).between(-8, 608)
    return view(spark, d, "images").where(on_screen).select("image_id")


@query("agg_18_stage_means", with_views("SELECT split_part(op, ':', 1) AS category, count(*) AS n, CAST(round(avg(us)) AS BIGINT) AS mean_us FROM perf_events GROUP BY 1", "perf_events"))
def _(spark, d):
    return results.stage_means(view(spark, d, "perf_events"))


@query("aln_07_result_rows", with_views("SELECT i.image_id, CASE WHEN score IS NULL THEN 'not-run' WHEN score >= 0.6 THEN 'ok' ELSE 'low-score' END AS status, coalesce(dx_nm, 0) AS dx FROM images i LEFT JOIN refined r ON i.image_id = r.image_id", "images", "refined"))
def _(spark, d):
    rows = results.with_status(view(spark, d, "images").withColumn("has_coords", F.lit(True)), view(spark, d, "refined"), 0.6)
    return rows.select("image_id", "status", F.coalesce("dx_nm", F.lit(0.0)).alias("dx"))


def _text(value: str, places: int) -> str:
    """SQL of a number as text with so many places, halves away from zero."""
    whole = f"CAST(floor(abs({value}) * {10**places} + 5e-1) AS BIGINT)"
    return f"coalesce(CASE WHEN {value} < 0 AND {whole} > 0 THEN '-' ELSE '' END || CAST({whole} // {10**places} AS VARCHAR) || '.' || lpad(CAST({whole} % {10**places} AS VARCHAR), {places}, '0'), '')"


_PNG = ", ".join(f"CASE WHEN status IN ('ok', 'low-score') THEN image_id || '_{k}.png' ELSE '' END AS {k}_png" for k in ("raw", "overlay", "gray", "label", "label_view"))


@query("snk_03_alignment", with_views(f"SELECT i.image_id, 'lot.001' AS klarf_path, 'chip.oas' AS gds_path, '10/0' AS poi_layer, CASE WHEN has_coords THEN {_text('(xrel - 1000)', 3)} ELSE '' END AS coarse_dx_nm, CASE WHEN has_coords THEN {_text('(yrel - 2000)', 3)} ELSE '' END AS coarse_dy_nm, {_text('dx_nm', 3)} AS fine_dx_nm, {_text('dy_nm', 3)} AS fine_dy_nm, {_text('score', 6)} AS score, '2.500000' AS nm_per_px FROM images i LEFT JOIN refined r ON i.image_id = r.image_id", "images", "refined"))
def _(spark, d):
    x, y = G.to_layout("xrel", "yrel", 1000, 2000)
    images = view(spark, d, "images").select("image_id", F.when(F.col("has_coords"), x).alias("coarse_x"), F.when(F.col("has_coords"), y).alias("coarse_y"))
    return results.alignment_rows(images, view(spark, d, "refined"), klarf_path="lot.001", gds_path="chip.oas", poi_layer="10/0", nm_per_px=2.5)


@query("snk_04_manifest", with_views(f"+r AS (SELECT i.*, dx_nm, dy_nm, score, CASE WHEN NOT has_coords THEN 'no-coords' WHEN score IS NULL THEN 'not-run' WHEN score >= 0.5 THEN 'ok' ELSE 'low-score' END AS status FROM images i LEFT JOIN refined r ON i.image_id = r.image_id) SELECT image_id, {_PNG}, status, {_text('dx_nm', 3)} AS fine_dx_nm, {_text('dy_nm', 3)} AS fine_dy_nm, {_text('score', 6)} AS score, 'defect' AS id_source, CASE WHEN n_pages > 0 THEN CAST(rec_no % 7 AS VARCHAR) ELSE '' END AS page, CAST(width_px AS VARCHAR) AS width_px, CAST(width_px AS VARCHAR) AS height_px, {_text('(1500e0 / width_px)', 6)} AS nm_per_px FROM r", "images", "refined"))
def _(spark, d):
    images = view(spark, d, "images").withColumns({"id_source": F.lit("defect"), "page": F.when(F.col("n_pages") > 0, F.col("rec_no") % 7), "height_px": F.col("width_px"), "nm_per_px": F.lit(1500.0) / F.col("width_px")})
    return results.manifest(images, view(spark, d, "refined"))


@query("snk_04_json", with_views(f"SELECT image_id, '{{\"image_id\":' || image_id || ',\"score\":\"' || {_text('score', 3)} || '\"}}' AS json FROM refined", "refined"))
def _(spark, d):
    rows = view(spark, d, "refined").select("image_id", results.fixed_point(F.col("score"), 3).alias("score"))
    return results.as_json(rows)


@query("srt_05_job_order", with_views("SELECT rec_no AS job_no, image_id, score FROM images JOIN refined USING (image_id) ORDER BY job_no", "images", "refined"))
def _(spark, d):
    """Results in the order in which their images were handed in."""
    return view(spark, d, "refined").join(view(spark, d, "images").select("image_id", "rec_no"), "image_id").select(F.col("rec_no").alias("job_no"), "image_id", "score").orderBy("job_no")


@query("srt_06_first_records", with_views("SELECT image_id, rec_no FROM images WHERE rec_no <= 5000", "images"))
def _(spark, d):
    return defects.up_to(view(spark, d, "images"), "rec_no", 5000).select("image_id", "rec_no")


@query("img_02_entries", with_views("""+t AS (SELECT image_id, n_pages, n_pages * 2 - CASE WHEN image_id % 11 = 0 THEN 1 ELSE 0 END AS have FROM images)
  SELECT image_id, CASE WHEN have >= n_pages * 2 THEN n_pages ELSE 0 END AS n, CASE WHEN have >= n_pages * 2 AND n_pages > 0 THEN 'p' || CAST(n_pages * 2 - 2 AS VARCHAR) END AS last_page FROM t""", "images"))
def _(spark, d):
    """Two values an image after the declared columns; a row that is cut off has no images."""
    have = F.col("n_pages") * 2 - F.when(F.col("image_id") % 11 == 0, 1).otherwise(0)
    extra = F.when(have > 0, F.transform(F.sequence(F.lit(0).cast("long"), have - 1), lambda k: F.concat(F.lit("p"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = view(spark, d, "images").select("image_id", "n_pages", F.concat(F.array(F.col("image_id").cast("string"), F.col("xrel").cast("string")), extra).alias("tokens"))
    found = rows.withColumn("entries", defects.image_entries("tokens", F.col("n_pages"), F.lit(2), F.lit(2)))
    return found.select("image_id", F.size("entries").cast("long").alias("n"), F.element_at(F.get("entries", F.size("entries") - 1), 1).alias("last_page"))


@query("img_01_layout", with_views("""+t AS (SELECT kind, n_pages AS n, n_pages * (CASE kind WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) + CASE WHEN image_id % 97 = 0 THEN 1 ELSE 0 END AS extra FROM images WHERE n_pages > 0),
  v AS (SELECT kind, extra // n AS per_image, count(*) AS votes FROM t WHERE extra > 0 AND extra % n = 0 GROUP BY 1, 2),
  b AS (SELECT kind, max(votes) AS votes, max_by(per_image, votes * 1000 - per_image) AS per_image FROM v GROUP BY kind), a AS (SELECT kind, count(*) AS total FROM t GROUP BY kind)
  SELECT b.kind, 2 AS start, CAST(per_image AS INTEGER) AS per_image, 'inferred' AS how FROM b JOIN a ON a.kind = b.kind WHERE votes >= total - greatest(1, total // 10)""", "images"))
def _(spark, d):
    """Where each lot's rows keep their images, by what most rows agree on."""
    per = F.when(F.col("kind") == "view", 3).when(F.col("kind") == "click", 2).otherwise(1)
    extra = F.col("n_pages") * per + F.when(F.col("image_id") % 97 == 0, 1).otherwise(0)
    tokens = F.concat(F.array(F.lit("1"), F.lit("2")), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(extra, F.lit(1))), lambda k: F.concat(F.lit("t"), k.cast("string"))))
    rows = view(spark, d, "images").where("n_pages > 0").select(F.col("kind").alias("path"), "rec_no", "n_pages", tokens.alias("tokens"))
    return defects.image_layout(rows, columns=2, count_at=1, list_at=None).select(F.col("path").alias("kind"), "start", "per_image", "how")


@query("snk_08_log_lines", with_views("SELECT seq, printf('%s %10.3f ms %s [%s]', upper(level), us / 1000, op, label) AS line FROM perf_events", "perf_events"))
def _(spark, d):
    return results.log_lines(view(spark, d, "perf_events"))


@query("srt_08_even_sample", with_views("+n AS (SELECT image_id, row_number() OVER (ORDER BY rec_no) - 1 AS k, count(*) OVER () AS c FROM images) SELECT image_id FROM n WHERE c <= 100 OR k = 0 OR (k * 100) // c > ((k - 1) * 100) // c", "images"))
def _(spark, d):
    return defects.evenly_spaced(view(spark, d, "images"), "rec_no", 100).select("image_id")


@query("klarf_nested", with_views("SELECT 'lot' || kind AS path, CAST(image_id AS VARCHAR) AS defect_id, xrel AS x_nm, CASE WHEN n_pages > 0 THEN 'img' || CAST(image_id AS VARCHAR) || '.tif' END AS image_file FROM images", "images"))
def _(spark, d):
    """The nested form, rendered for each kind and 500 images, and read back."""
    rows = view(spark, d, "images")
    image = F.when(F.col("n_pages") > 0, F.concat(F.lit('Images 1 { "img'), "image_id", F.lit('.tif" "TIFF" 1 "x" }'))).otherwise("0")
    line = F.concat(F.col("image_id").cast("string"), F.lit(" "), F.col("xrel").cast("string"), F.lit("\n  "), image, F.lit(" ;"))
    head = F.lit("Record FileRecord \"1.8\" {\nField Version 1 {\"1.8\"}\nList DefectList {\nColumns 3 { int32 DEFECTID, int32 XREL, ImageList IMAGEINFO }\nData ")
    files = rows.groupBy("kind", F.floor(F.col("rec_no") / 500).alias("part")).agg(F.concat(head, F.count("*").cast("string"), F.lit(" {\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n}\n}\n}\nEndOfFile;")).alias("content"))
    parsed = defects.parse_nested(files.select(F.concat(F.lit("lot"), "kind").alias("path"), "content"))
    return parsed.select("path", F.col("values")["DEFECTID"].alias("defect_id"), F.col("values")["XREL"].try_cast("bigint").alias("x_nm"), "image_file")


@query("src_10_facts", with_views("SELECT 'lot' || kind AS path, '1.2' AS version, 1 + CAST(kind = 'view' AS INTEGER) AS n_lists, CAST(count(*) AS VARCHAR) AS stated, 'class ' || kind AS name FROM images GROUP BY kind", "images"))
def _(spark, d):
    """What the head and foot of a list say: its version, its lists, a class and its own count."""
    rows = view(spark, d, "images").groupBy("kind").agg(F.count("*").cast("string").alias("n"), F.min("image_id").cast("string").alias("first"))
    body = F.concat(F.lit("DefectList\n "), "first", F.lit(" 1;\n"))
    content = F.concat(F.lit('FileVersion 1 2;\nClassLookup 2\n 0 "none"\n 7 "class '), "kind", F.lit('"\n;\n'), body, F.when(F.col("kind") == "view", body).otherwise(""), F.lit("SummarySpec 2 TESTNO NDEFECT ;\nSummaryList\n 1 "), "n", F.lit(" ;\nEndOfFile;"))
    files = rows.select(F.concat(F.lit("lot"), "kind").alias("path"), content.alias("content"))
    names = defects.class_names(files).where("number = 7").select("path", "name")
    return defects.list_facts(files).join(names, "path").select("path", "version", "n_lists", F.col("summary")["NDEFECT"].alias("stated"), "name")


@query("src_14_dispatch", with_views("SELECT 'lot' || kind AS path, CASE WHEN kind IN ('view', 'error') THEN '1.8' ELSE '1.2' END AS version, CAST(image_id AS VARCHAR) AS defect_id, xrel AS x_nm FROM images", "images"))
def _(spark, d):
    """Lists of both forms in one folder, told apart by their first line."""
    rows = view(spark, d, "images").withColumn("nested", F.col("kind").isin("view", "error"))
    line = F.when(F.col("nested"), F.concat(F.col("image_id").cast("string"), F.lit(" "), F.col("xrel").cast("string"), F.lit(" ;"))).otherwise(F.concat_ws(" ", "image_id", "xrel"))
    body = rows.groupBy("kind", "nested", F.floor(F.col("rec_no") / 500).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("body"), F.count("*").cast("string").alias("n"))
    nested = F.concat(F.lit('\nRecord FileRecord "1.8" {\nList DefectList {\nColumns 2 { int32 DEFECTID, int32 XREL }\nData '), "n", F.lit(" {\n"), "body", F.lit("\n}\n}\n}\nEndOfFile;"))
    flat = F.concat(F.lit("FileVersion 1 2;\nDefectRecordSpec 2 DEFECTID XREL ;\nDefectList\n"), "body", F.lit(";\nEndOfFile;"))
    files = body.select(F.concat_ws("-", F.concat(F.lit("lot"), "kind"), "part").alias("path"), F.when(F.col("nested"), nested).otherwise(flat).alias("content"))
    parsed = defects.parse_lists(files)
    return parsed.select(F.substring_index("path", "-", 1).alias("path"), "version", F.col("values")["DEFECTID"].alias("defect_id"), F.col("values")["XREL"].try_cast("bigint").alias("x_nm"))


@query("str_01_totals", with_views("SELECT op, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us FROM perf_events GROUP BY op", "perf_events"))
def _(spark, d):
    return live.settled(live.by_operation(live_view(spark, d, "perf_events")), "complete")


@query("str_02_windows", with_views("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, label, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us FROM perf_events GROUP BY 1, 2", "perf_events"))
def _(spark, d):
    found = live.settled(live.by_window(live_view(spark, d, "perf_events")), "complete")
    return found.select(F.unix_timestamp("start").alias("start_s"), "label", "n", "total_us")


@query("str_03_keep_better", with_views("SELECT image_id, max(score) AS score FROM (SELECT image_id, score FROM refined UNION ALL SELECT image_id, score FROM rerun) WHERE score IS NOT NULL GROUP BY image_id", "refined", "rerun"))
def _(spark, d):
    """Results of two runs as they come in; the best of each image is the last one kept."""
    runs = live_view(spark, d, "refined").unionByName(live_view(spark, d, "rerun"))
    return live.settled(live.keep_better(runs), "append").groupBy("image_id").agg(F.max("score").alias("score"))


@query("str_04_latest", with_views("SELECT op, max(seq) AS seq, max_by(us, seq) AS us FROM perf_events GROUP BY op", "perf_events"))
def _(spark, d):
    return live.settled(live.latest(live_view(spark, d, "perf_events").select("op", "seq", "us"), "op", "seq"), "complete")


@query("img_03_page_map", with_views("+t AS (SELECT count(*) * 4 AS total FROM images), m AS (SELECT image_id, unnest(range(image_id * 4 + 1, image_id * 4 + 1 + n_pages)) AS id FROM images), s AS (SELECT CASE WHEN count(*) = count(DISTINCT id) THEN CASE WHEN min(id) = 0 AND max(id) < max(total) THEN 0 WHEN min(id) >= 1 AND max(id) <= max(total) THEN 1 END END AS base FROM m, t) SELECT image_id, id - base AS page, 'imagelist' AS mode FROM m, s", "images"))
def _(spark, d):
    images = view(spark, d, "images")
    listed = F.when(F.col("n_pages") > 0, F.sequence(F.col("image_id") * 4 + 1, F.col("image_id") * 4 + F.col("n_pages"))).otherwise(F.array().cast("array<bigint>"))
    return defects.page_map(images.withColumn("ids", listed), F.lit(images.count() * 4))


@query("klarf_flat18", with_views("SELECT 'lot' || kind AS path, CAST(image_id AS VARCHAR) AS defect_id, xrel AS x_nm, CASE WHEN n_pages > 0 THEN 'a;b } ' || CAST(image_id AS VARCHAR) || ', x.tif' END AS image_file, CASE WHEN n_pages = 0 THEN '\"left; over\"' END AS extra FROM images", "images"))
def _(spark, d):
    """The flat form that names its columns in the list's line; rows wrap, quoted texts hold marks."""
    rows = view(spark, d, "images")
    image = F.when(F.col("n_pages") > 0, F.concat(F.lit('Image 1 { "a;b } '), "image_id", F.lit(', x.tif" "T" }'))).otherwise('0 "left; over"')
    line = F.concat(F.col("image_id").cast("string"), F.lit("\n  "), F.col("xrel").cast("string"), F.lit(" "), image, F.lit(" ;"))
    foot = F.lit("\nEndOfList\nDefectList 1 OTHER\nData 1\n 5 ;\nEndOfList\nEndOfFile;")
    files = rows.groupBy("kind", F.floor(F.col("rec_no") / 500).alias("part")).agg(F.concat(F.lit("FileVersion 1 8;\nDefectList 3 DEFECTID XREL IMAGELIST\nData "), F.count("*").cast("string"), F.lit("\n"), F.array_join(F.collect_list(line), "\n"), foot).alias("content"))
    parsed = defects.parse_lists(files.select(F.concat_ws("-", F.concat(F.lit("lot"), "kind"), "part").alias("path"), "content"))
    return parsed.select(F.substring_index("path", "-", 1).alias("path"), F.col("values")["DEFECTID"].alias("defect_id"), F.col("values")["XREL"].try_cast("bigint").alias("x_nm"), "image_file", F.col("values")["_extra_1"].alias("extra"))


@query("aln_10_status", with_views("+run AS (SELECT image_id, dx_nm, dy_nm, coalesce(score, 0e0) AS score, CASE WHEN score IS NULL THEN 'flat' ELSE 'ok' END AS status FROM rerun) SELECT image_id, dx_nm, dy_nm, score FROM refined WHERE image_id NOT IN (SELECT image_id FROM run) UNION ALL SELECT image_id, dx_nm, dy_nm, score FROM run WHERE status = 'ok'", "refined", "rerun"))
def _(spark, d):
    """A run whose failures carry a status and a score of zero, as matching gives them."""
    status = F.when(F.col("score").isNull(), "flat").otherwise("ok")
    run = view(spark, d, "rerun").withColumn("status", status).withColumn("score", F.coalesce("score", F.lit(0.0)))
    return results.apply_run(view(spark, d, "refined"), run)


_LATE = "seq % 7 = 0"
_MARKS = f"""+e AS (SELECT *, {_LATE} AS late, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS till FROM perf_events),
  wm AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 10 MINUTE AS first, max(ts) - INTERVAL 10 MINUTE AS final FROM e)"""


@query("str_05_late_windows", with_views(f"{_MARKS} SELECT CAST(epoch(till - INTERVAL 1 HOUR) AS BIGINT) AS start_s, label, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us FROM e, wm WHERE till <= final AND (NOT late OR till > first) GROUP BY till, label", "perf_events"))
def _(spark, d):
    """Windows that end: a seventh of the events come late, after windows have been closed."""
    events = view(spark, d, "perf_events")
    return live.in_parts([events.where(f"not ({_LATE})"), events.where(_LATE)], live.by_window).select(F.unix_timestamp("start").alias("start_s"), "label", "n", "total_us")


@query("str_06_sessions", with_views("+m AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY op ORDER BY ts, seq) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM perf_events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY op ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT op, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY op, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM perf_events)", "perf_events"))
def _(spark, d):
    """Sessions of each operation, as far as the watermark has closed them."""
    return live.in_parts([view(spark, d, "perf_events")], live.sessions).select("op", F.unix_micros("start").alias("start_us"), "n")


@query("str_07_silent", with_views("SELECT op, epoch_us(max(ts)) AS last_us, count(*) AS n FROM perf_events GROUP BY op HAVING max(ts) + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 10 MINUTE FROM perf_events)", "perf_events"))
def _(spark, d):
    """Operations whose timer has gone off."""
    return live.in_parts([view(spark, d, "perf_events")], live.silent).select("op", F.unix_micros("last_ts").alias("last_us"), "n")
