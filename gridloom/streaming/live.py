"""Live summaries of timed operations, and results that only get better."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.ordered import shared_folder

#: Buckets that images are dealt to, each with one state.
BUCKETS = 1024


def settled(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has to say once it has read all that is there now.

    Batches are written to the shared folder: each in the place of the one before
    if the mode is complete, next to it if not.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream has said once each part has come in and been read, in this order.

    Every part is one run, which goes on from the checkpoint of the run before: its
    state and its watermark are what a stream that was stopped would find. A run ends
    when there is nothing more to read and no state that the watermark has passed.
    """
    spark = parts[0].sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    for number, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/part={number}")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{folder}/in/*"))
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark; a time without zone counts in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def by_operation(events: DataFrame) -> DataFrame:
    """Running count, total and largest time of every operation."""
    return events.groupBy("op").agg(F.count("*").alias("n"), F.sum("us").alias("total_us"), F.max("us").alias("max_us"))


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same by time window.

    In append mode a window is said once, when the watermark has passed its end;
    events that come after that are dropped, and the state of the window is freed.
    """
    windowed = timed(events, late).groupBy(F.window("ts", width).alias("w"), "label")
    return windowed.agg(F.count("*").alias("n"), F.sum("us").alias("total_us")).select(F.col("w.start").alias("start"), "label", "n", "total_us")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of one operation's events without a gap, each said when the watermark has passed its end."""
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def silent(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(op, last_ts, n): operations that have had no event for ``gap``, with their events until then.

    A timer for each operation, set anew by every event; it goes off when the
    watermark has passed it. The state is a number and a time, and is freed then.
    """
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"op": [key[0]], "last_ts": [pd.Timestamp(last, unit="us")], "n": [n]})
            return
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["us_since"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    rows = timed(events, late).select("op", "ts", F.unix_micros("ts").alias("us_since"))
    return rows.groupBy("op").applyInPandasWithState(step, "op string, last_ts timestamp, n long", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """For every key its latest row; a refresh shows that row, however many came before."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def keep_better(results: DataFrame, forget: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """For every image, each result that is strictly better than all before.

    Images are dealt to ``buckets`` by a hash, as one call for each image would cost
    far more than its comparison. The state is two numbers for each image, an id and
    a score, as the two arrays of its bucket. With ``forget``, such as "7 days", a
    third number says when an image last had a result, and it is dropped after so
    long without one; a stream that is to end by itself must not set it, as it would
    wait for that time to pass. ``buckets`` must not change between runs from one
    checkpoint.
    """
    rest = forget and int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, best, seen = (np.frombuffer(x, t) for x, t in zip(state.get, ("i8", "f8", "i8"), strict=True)) if state.exists else (np.zeros(0, t) for t in ("i8", "f8", "i8"))
        if not rest:
            seen = np.zeros(len(ids), np.int64)
        now = state.getCurrentProcessingTimeMs() if rest else 0
        came = [np.zeros(0, np.int64)]
        if not state.hasTimedOut:
            for frame in frames:
                came.append(frame["number"].to_numpy())
                scored = frame[frame["score"] > float("-inf")]
                number = scored["number"].to_numpy()
                fresh = np.setdiff1d(number, ids)
                ids, best, seen = np.r_[ids, fresh], np.r_[best, np.full(len(fresh), -np.inf)], np.r_[seen, np.zeros(len(fresh), np.int64)]
                order = np.argsort(ids)
                ids, best, seen = ids[order], best[order], seen[order]
                at = np.searchsorted(ids, number)
                # the best before a row: of the state, and of the rows of its image above it
                above = scored["score"].groupby(number).cummax().groupby(number).shift(fill_value=float("-inf")).to_numpy()
                score = scored["score"].to_numpy()
                better = score > np.maximum(above, best[at])
                np.maximum.at(best, at, score)
                if better.any():
                    out = scored[better]
                    yield out[["dx_nm", "dy_nm", "score"]].assign(image_id=None if key[0] < 0 else out["number"])[["image_id", "dx_nm", "dy_nm", "score"]]
        if rest:
            seen = np.where(np.isin(ids, np.concatenate(came)), now, seen)
            left = seen + rest > now
            ids, best, seen = ids[left], best[left], seen[left]
        if len(ids):
            state.update((ids.tobytes(), best.tobytes(), seen.tobytes() if rest else b""))
            if rest:
                state.setTimeoutDuration(int(max(seen.min() + rest - now, 1)))
        elif state.exists:
            state.remove()

    # images without an id are one, in a bucket of its own, as a column with nulls would come as inexact numbers
    bucket = F.when(F.col("image_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("image_id"), F.lit(buckets))).cast("int")
    dealt = results.select(bucket.alias("bucket"), F.coalesce("image_id", F.lit(0)).cast("long").alias("number"), "dx_nm", "dy_nm", "score")
    return dealt.groupBy("bucket").applyInPandasWithState(step, "image_id long, dx_nm double, dy_nm double, score double", "ids binary, best binary, seen binary", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
