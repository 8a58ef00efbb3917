"""Results that hang on a total order: running sums and last seen values.

Rows are dealt out by ranges of the order, so that ranges hold about as many rows
each whatever the keys look like; a window sees one range, and one row for each
range is carried on to the ranges after it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Where nothing is set a folder is made if Spark runs on one machine, as in
    tests; on a cluster every machine would have another one, so that is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that the machines share; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _in_ranges(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    return kept(rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _before() -> Window:
    return Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def running_total(rows: DataFrame, order: str | list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, in a unique order."""
    order = [order] if isinstance(order, str) else order
    ranged = _in_ranges(rows, order, value)
    starts = ranged.groupBy("_range").agg(F.sum("_v").alias("_s")).select("_range", F.coalesce(F.sum("_s").over(_before()), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_v", "_in", "_start")


def last_seen(rows: DataFrame, order: str | list[str], value: Column, name: str) -> DataFrame:
    """``name``: the latest value that is not null, up to and with each row."""
    order = [order] if isinstance(order, str) else order
    ranged = _in_ranges(rows, order, value)
    ends = ranged.groupBy("_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    starts = ends.select("_range", F.last("_end", ignorenulls=True).over(_before()).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    return seen.join(F.broadcast(starts), "_range").withColumn(name, F.coalesce("_in", "_start")).drop("_range", "_v", "_in", "_start")


def next_value(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``name``: the order's value of the following row, null for the last."""
    ranged = _in_ranges(rows, [order], F.lit(None).cast("int"))
    heads = ranged.groupBy("_range").agg(F.min(order).alias("_head"))
    heads = heads.select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_after"))
    own = F.lead(order).over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_own", own).join(F.broadcast(heads), "_range").withColumn(name, F.coalesce("_own", "_after")).drop("_range", "_v", "_own", "_after")
