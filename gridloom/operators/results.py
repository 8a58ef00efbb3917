"""Match results: status, filters, keep-if-better, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import kept

#: Status words and the score that counts as good by default.
OK, LOW, NOT_RUN, NO_COORDS = "ok", "low-score", "not-run", "no-coords"
MIN_SCORE = 0.5


def passes(score: str = "score", threshold: float = MIN_SCORE) -> Column:
    """A score that is there and reaches the threshold."""
    return F.col(score).isNotNull() & (F.col(score) >= threshold)


def low(score: str = "score", threshold: float = MIN_SCORE) -> Column:
    return F.col(score).isNotNull() & (F.col(score) < threshold)


def needs_run(images: DataFrame, refined: DataFrame) -> DataFrame:
    """Images with coordinates that have no result yet."""
    return images.where("has_coords").join(refined.select("image_id").distinct(), "image_id", "left_anti")


def subset(images: DataFrame, wanted: DataFrame) -> DataFrame:
    return images.join(wanted.select("image_id").distinct(), "image_id", "left_semi")


def with_status(images: DataFrame, refined: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """Every image with its result and a manifest status; a score at the threshold is ok."""
    status = F.when(~F.col("has_coords"), NO_COORDS).when(F.col("score").isNull(), NOT_RUN).when(F.col("score") >= threshold, OK).otherwise(LOW)
    return images.join(refined, "image_id", "left").withColumn("status", status)


def succeeded(run: DataFrame) -> Column:
    """Whether a row of a run is a result: it has a score and, where the run has a ``status``, that is ok."""
    scored = F.col("score").isNotNull()
    return scored & (F.col("status") == OK) if "status" in run.columns else scored


def keep_better(old: DataFrame, new: DataFrame) -> DataFrame:
    """One result an image: the new one only if its score is strictly better.

    A new row that is no result (see :func:`succeeded`) replaces nothing, and is not
    stored either.
    """
    values = ["dx_nm", "dy_nm", "score"]
    both = old.alias("o").join(new.where(succeeded(new)).alias("n"), "image_id", "full")
    take_new = F.col("n.score").isNotNull() & (F.col("o.score").isNull() | (F.col("n.score") > F.col("o.score")))
    return both.select("image_id", *(F.when(take_new, F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values), F.when(take_new, "new").otherwise("old").alias("kept"))


def apply_run(old: DataFrame, run: DataFrame) -> DataFrame:
    """Results after a full run: ok rows replace, any other run row removes."""
    good = run.where(succeeded(run)).select("image_id", "dx_nm", "dy_nm", "score")
    return old.join(run.select("image_id"), "image_id", "left_anti").select("image_id", "dx_nm", "dy_nm", "score").unionByName(good)


def histogram(scores: DataFrame, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) for every bin; both ends are clamped, nulls are skipped."""
    spark = scores.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if high <= low:
        return every.withColumn("n", F.lit(0).cast("long"))
    at = F.floor((F.col("score") - low) / (high - low) * bins)
    counted = scores.where("score is not null").groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(counted), "bin", "left").na.fill(0)


def color_class(score: str = "score") -> Column:
    return F.when(F.col(score).isNull(), "none").when(F.col(score) >= 0.7, "good").when(F.col(score) >= 0.5, "fair").otherwise("poor")


def exact_medians(rows: DataFrame, by: str, values: list[str], least: int = 100_000) -> DataFrame:
    """(by, medians): the middle value of each group, or the mean of the middle two; nulls are left out.

    Groups of up to ``least`` values are sorted where they are. Of larger ones no task
    ever holds all values: rounds of histograms, for all groups and columns at once,
    narrow the stretch in which a middle value lies, until it holds few enough values
    or only one. A round moves one row a bin.
    """
    bins = 1024
    long = rows.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(v).cast("double").alias("v")) for k, v in enumerate(values)))).alias("_s")).select(by, "_s.c", "_s.v").where("v is not null")
    ends = kept(long.groupBy(by, "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    # both middle places of a group, counted from 0; they are one if the number is odd
    places = F.array_distinct(F.array(*(F.floor(x / 2).cast("long") for x in (F.col("n") - 1, F.col("n")))))
    todo = kept(ends.select(by, "c", F.explode(places).alias("place"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
    found = []
    while True:
        few = todo.where((F.col("inside") <= least) & (F.col("lo") < F.col("hi")))
        single = todo.where(F.col("lo") == F.col("hi"))
        found.append(single.select(by, "c", "place", F.col("lo").alias("v")))
        asked = few.select(F.col(by).alias("_by"), F.col("c").alias("_c"), "place", "lo", "hi", "before")
        same = (F.col(by).eqNullSafe(F.col("_by"))) & (F.col("c") == F.col("_c"))
        sorted_ = long.join(asked.hint("merge"), same).where("v between lo and hi").groupBy(by, "c", "place", "before").agg(F.array_sort(F.collect_list("v")).alias("_vs"))
        found.append(sorted_.select(by, "c", "place", F.get("_vs", (F.col("place") - F.col("before")).cast("int")).alias("v")))
        heavy = todo.where((F.col("inside") > least) & (F.col("lo") < F.col("hi")))
        if heavy.isEmpty():
            break
        asked = heavy.select(F.col(by).alias("_by"), F.col("c").alias("_c"), "place", "lo", "hi", "before")
        at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
        counted = long.join(asked.hint("merge"), same).where("v between lo and hi").groupBy(by, "c", "place", "before", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(by, "c", "place").orderBy("bin"))
        summed = counted.withColumn("upto", F.col("before") + upto).where("place < upto and place >= upto - n")
        todo = kept(summed.select(by, "c", "place", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("inside")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    every = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))  # groups of nulls alone too
    held = every.select(by, F.lit(-1).alias("c"), F.lit(None).cast("double").alias("v")).unionByName(out.select(by, "c", "v"))
    return held.groupBy(by).agg(*(F.avg(F.when(F.col("c") == k, F.col("v"))).alias(v) for k, v in enumerate(values)))


def medians(rows: DataFrame, by: str) -> DataFrame:
    """Medians of offsets and length by group; the middle two are averaged."""
    length = F.sqrt(F.col("dx_nm") * F.col("dx_nm") + F.col("dy_nm") * F.col("dy_nm"))
    found = exact_medians(rows.select(by, F.col("dx_nm").alias("dx"), F.col("dy_nm").alias("dy"), length.alias("length")), by, ["dx", "dy", "length"])
    return found.withColumn("length", F.round("length", 6))


def perf_summary(events: DataFrame) -> DataFrame:
    """By operation: count, total, largest, mean, and the last event's fields."""
    last = lambda c: F.max_by(c, "seq").alias(f"last_{c}")
    return events.groupBy("op").agg(F.count("*").alias("n"), F.sum("us").alias("total_us"), F.max("us").alias("max_us"), F.min("seq").alias("first_seq"), last("us"), last("label"), last("level"), F.round(F.sum("us") / F.count("*"), 3).alias("avg_us")).withColumn("category", F.substring_index("op", ":", 1))


def share_by_category(events: DataFrame, categories: list[str], top: int) -> DataFrame:
    """Time by category, the rest as 'other', with its share of all time."""
    name = F.substring_index("op", ":", 1)
    bucket = F.when(name.isin(categories), name).otherwise("other")
    by = events.groupBy(bucket.alias("category")).agg(F.sum("us").alias("us"))
    total = events.agg(F.sum("us").alias("all_us"))
    return by.join(F.broadcast(total)).select("category", "us", F.round(F.col("us") / F.col("all_us"), 6).alias("share")).orderBy(F.desc("us"), "category").limit(top)


def duplicate_labels(labels: DataFrame) -> DataFrame:
    """Layers named by more than one id, with the first owner."""
    return labels.groupBy("layer").agg(F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id")).where("n_ids > 1")


def label_problems(labels: DataFrame) -> DataFrame:
    """Names with characters outside [A-Za-z0-9_], or with a leading digit."""
    bad = F.regexp_replace("layer", "[A-Za-z0-9_]", "")
    digit = F.col("layer").rlike("^[0-9]")
    return labels.select("id", "layer", bad.alias("invalid_chars"), digit.alias("leading_digit")).where((bad != "") | digit)


def log_lines(events: DataFrame) -> DataFrame:
    """One line of text for each timed operation."""
    return events.select("seq", F.format_string("%s %10.3f ms %s [%s]", F.upper("level"), F.col("us") / 1000, F.col("op"), F.col("label")).alias("line"))


def stage_means(events: DataFrame) -> DataFrame:
    """Mean time by category, to the microsecond."""
    return events.groupBy(F.substring_index("op", ":", 1).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("us")).cast("long").alias("mean_us"))


def fixed_point(value: Column, places: int) -> Column:
    """A number as text with so many places, halves away from zero; '' for null.

    Rounded as a whole number, so that the text depends on no engine's rounding
    of decimals.
    """
    scale = 10**places
    whole = F.floor(F.abs(value) * scale + 0.5).cast("long")
    sign = F.when((value < 0) & (whole > 0), "-").otherwise("")
    text = F.concat(sign, F.floor(whole / scale).cast("long").cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), places, "0"))
    return F.coalesce(text, F.lit(""))


#: The columns of both tables that are exported, in order.
ALIGNMENT_COLUMNS = "image_id klarf_path gds_path poi_layer coarse_dx_nm coarse_dy_nm fine_dx_nm fine_dy_nm score nm_per_px".split()
MANIFEST_COLUMNS = "image_id raw_png overlay_png fine_dx_nm fine_dy_nm score status gray_png label_png id_source page width_px height_px nm_per_px label_view_png".split()


def alignment_rows(images: DataFrame, refined: DataFrame, *, klarf_path: str = "", gds_path: str = "", poi_layer: str = "", nm_per_px: float = 0.0) -> DataFrame:
    """The ten columns of the alignment export, as text.

    ``images`` holds coarse_x and coarse_y, null without coordinates. What is not
    known or has not been run is an empty string, not zero.
    """
    found = images.join(refined.select("image_id", "dx_nm", "dy_nm", "score"), "image_id", "left")
    texts = {"klarf_path": F.lit(klarf_path), "gds_path": F.lit(gds_path), "poi_layer": F.lit(poi_layer), "coarse_dx_nm": fixed_point(F.col("coarse_x"), 3), "coarse_dy_nm": fixed_point(F.col("coarse_y"), 3), "fine_dx_nm": fixed_point(F.col("dx_nm"), 3), "fine_dy_nm": fixed_point(F.col("dy_nm"), 3), "score": fixed_point(F.col("score"), 6), "nm_per_px": fixed_point(F.lit(float(nm_per_px)), 6)}
    return found.select("image_id", *(texts[c].alias(c) for c in ALIGNMENT_COLUMNS[1:]))


def manifest(images: DataFrame, refined: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """The fifteen columns of the overlay manifest, as text.

    ``images`` holds id_source, page, width_px, height_px and nm_per_px. Pictures
    are named for images that were matched; the rest have empty strings, as has
    what is not known.
    """
    safe = F.regexp_replace(F.col("image_id").cast("string"), "[^A-Za-z0-9_-]", "_")
    rows = with_status(images, refined, threshold)
    drawn = F.col("status").isin(OK, LOW)
    picture = lambda kind: F.when(drawn, F.concat(safe, F.lit(f"_{kind}.png"))).otherwise("")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = {
        "raw_png": picture("raw"), "overlay_png": picture("overlay"), "gray_png": picture("gray"), "label_png": picture("label"), "label_view_png": picture("label_view"),
        "fine_dx_nm": fixed_point(F.col("dx_nm"), 3), "fine_dy_nm": fixed_point(F.col("dy_nm"), 3), "score": fixed_point(F.col("score"), 6), "status": F.col("status"),
        "id_source": plain("id_source"), "page": plain("page"), "width_px": plain("width_px"), "height_px": plain("height_px"), "nm_per_px": fixed_point(F.col("nm_per_px"), 6),
    }
    return rows.select("image_id", *(texts[c].alias(c) for c in MANIFEST_COLUMNS[1:]))


def as_json(rows: DataFrame) -> DataFrame:
    """(image_id, json): every row as one JSON object, keys in the order of the columns."""
    return rows.select("image_id", F.to_json(F.struct(*rows.columns)).alias("json"))
