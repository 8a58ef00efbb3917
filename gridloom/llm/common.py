"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: A key is heavy if more than one row in HEAVY has it, and more rows than any task minds.
HEAVY, LIGHT_ROWS = 1000, 1000
#: Keys that one task reads back, about.
KEYS_PER_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where nothing is set and
    Spark runs on one machine, as in tests, a folder is made here; on a cluster
    each machine would have another one, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """The rows, written once to the shared folder, and aggregates of them.

    What was written survives lost executors. The aggregates are taken while the
    rows are written; a task that is run again may count twice, so they steer how
    steps are laid out and never what comes out.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, *(c.alias(n) for n, c in metrics.items())).checkpoint(eager=True)
    return out, seen.get


def cut(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """The rows, written once to the shared folder; survives lost executors.

    With ``rows_per_task`` the rows are read back in as few tasks as that allows,
    so that many small steps do not each write a file for every task.
    """
    if rows_per_task is None:
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    out, seen = measured(df, n=F.count(F.lit(1)))
    return out.coalesce(seen["n"] // rows_per_task + 1)


def measured_keys(keys: DataFrame) -> tuple[DataFrame, dict]:
    """A table of keys, written, with what :func:`join_keys` needs to know of its ``_n``."""
    keys, seen = measured(keys, total=F.coalesce(F.sum("_n"), F.lit(0)), most=F.coalesce(F.max("_n"), F.lit(0)), n=F.count(F.lit(1)))
    return keys.coalesce(seen["n"] // KEYS_PER_TASK + 1), seen


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], by: str, how: str = "inner", seen: dict | None = None) -> DataFrame:
    """``rows`` joined with ``keys``, one row for each key, without a task for a hot key.

    ``keys`` says in ``_n`` how many rows share the key, and is dropped from the
    result by that name. If a key is heavy, rows are dealt to parts of their key by
    the column ``by``; a key is copied to the parts that it has, in a first join in
    which no key has more rows than there are parts, and meets its rows part by
    part in a second one. Nothing is broadcast, so the driver holds none of it.
    ``rows`` are read more than once and should be cut; ``keys`` are written here,
    unless they come from :func:`measured_keys` with what was ``seen``. ``how`` is
    inner, left, left_semi or left_anti.
    """
    if seen is None:
        keys, seen = measured_keys(keys)
    keys = keys.drop("_n").hint("merge")
    least = max(LIGHT_ROWS, seen["total"] // HEAVY)
    if seen["most"] <= least:
        return rows.join(keys, on, how)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(-(-seen["most"] // least))))
    copies = dealt.select(*on, "_part").distinct().join(keys, on)
    return dealt.join(copies.hint("merge"), [*on, "_part"], how).drop("_part")


def unused(columns: list[str], wish: str) -> str:
    """A column name like ``wish`` that is not among ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task turns few texts into objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc_bucket(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))
