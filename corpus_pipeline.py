"""The corpus pipeline: five stages, each one operator on all its input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. :func:`run` writes every stage's rows to
the shared folder and reads them again for the next.

Stages that compare documents name rows by hashes of id and text, so that null
and repeated ids lose nothing and let nothing through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, neardup, pii, quality
from gridloom.llm.common import shared_dir, table, unused


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with two hashes of id and text, and the names of these columns.

    They name a row by what the stages look at: rows that share an id keep apart
    if their texts differ, and rows without an id are named like all others.
    """
    names = [unused(docs.columns, wish) for wish in ("_key", "_key2")]
    return docs.withColumns({n: F.xxhash64(F.lit(i), "doc_id", "text") for i, n in enumerate(names)}), names


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored by their statistics like others, equal texts
    alike; null and repeated ids make no difference; an empty table stays empty;
    other columns pass through. A very long text is scored whole.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one of smallest id.

    Null ids come last. Rows of one id are compared by their texts like any
    others, and rows of equal id and text count once. Texts without words are
    near to nothing and all stay; an empty table stays empty; other columns,
    whatever their names, pass through. A very long text is compared by all its
    words.
    """
    keyed, (key, key2) = _keyed(docs)
    words = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) != ""
    found = neardup.classes(keyed.where(words).select(F.col(key).alias("row"), "text", "doc_id", F.col(key2).alias("row2")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "row2")
    best = found.groupBy("label").agg(F.min_by(F.struct("row", "row2"), order).alias("s")).select(F.col("s.row").alias(key), F.col("s.row2").alias(key2))
    nth = unused([*docs.columns, key, key2], "_nth")
    first = keyed.where(words).withColumn(nth, F.row_number().over(Window.partitionBy(key, key2).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return first.join(best, [key, key2], "left_semi").select(*docs.columns).unionByName(docs.where(~words))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds benchmark passages, by the rule of op4, go.

    Each row goes or stays by its own text, null and repeated ids included; null
    and empty texts stay; an empty table or benchmark changes nothing; other
    columns pass through. A very long text is searched whole.
    """
    keyed, names = _keyed(docs)
    found = decontaminate.hits(keyed.select(F.struct(*names).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where(decontaminate.contaminated()).select("doc_id.*").distinct()
    return keyed.join(bad, names, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind.

    Null and empty texts stay as they are; every row has its own result; an empty
    table stays empty; other columns pass through. A very long text is masked whole.
    """
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    A null text counts as empty; every row has its own result, null and repeated
    ids included; an empty table gives no rows; other columns are left out. A very
    long text is encoded whole.
    """
    return bpe.summarize(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: No SQL: the classifier is fitted here. Tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's rows are removed once the next stage has written its own; those of
    the last one stay, as the result is read from them.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
