"""Windows, sessions, state and idempotent ingest over streams of events.

The watermark is this engine's choice: ten minutes; in append mode, rows later than that are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL

WATERMARK = "10 minutes"


def stream(spark: SparkSession, path: str, like: DataFrame, stamp: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream, its time as a timestamp (a watermark needs one)."""
    reader = spark.readStream.schema(like.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn(stamp, F.col(stamp).cast("timestamp"))


def throughput(events: DataFrame, stamp: str, key: str, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    over = F.window(stamp, window, slide) if slide else F.window(stamp, window)
    return events.withWatermark(stamp, WATERMARK).groupBy(over.alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, stamp: str, key: str, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(stamp, WATERMARK).groupBy(F.session_window(stamp, gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def fold_states(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The status of one key: the first terminal status stays, else the last one counts. Of each Arrow batch only its first
    terminal row and its last row are kept, so that a key's rows never meet in memory."""
    status, n = state.get if state.exists else (None, 0)
    first = last = None
    for rows in batches:
        n += len(rows)
        order = rows.sort_values(["created_at", "job_id"])[["created_at", "job_id", "status"]]
        ended = order[order["status"].isin(TERMINAL)]
        for found in ended.head(1).itertuples(index=False, name=None):
            first = found if first is None else min(first, found)
        for found in order.tail(1).itertuples(index=False, name=None):
            last = found if last is None else max(last, found)
    if status not in TERMINAL and last is not None:
        status = (first or last)[2]
    state.update((status, n))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "events": [n]})


def states(events: DataFrame) -> DataFrame:
    """user_id, status, events, again for each key that a batch touches."""
    return events.select("user_id", "job_id", "created_at", "status").groupBy("user_id").applyInPandasWithState(fold_states, "user_id long, status string, events long", "status string, events long", "update", GroupStateTimeout.NoTimeout)


def once_each(rows: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return rows.withWatermark(stamp, WATERMARK).dropDuplicatesWithinWatermark([key])


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """For foreachBatch: appends the rows whose key isn't stored under the path yet, so that a repeated batch adds nothing."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("append").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)


def available(df: DataFrame, folder: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its result: in complete mode the last one, in update mode the last
    row of each key, in append mode everything."""
    path, spark = f"{folder}/stream-{uuid.uuid4().hex}", df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        out = batch if mode == "append" else batch.withColumn("_batch", F.lit(number))
        out.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    found = spark.read.parquet(f"{path}/rows")
    if mode == "complete":
        return found.drop("_batch")
    if mode == "update" and key:
        rest = [c for c in found.columns if c not in (*key, "_batch")]
        last = found.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
        return last.select(*key, "r.*")
    return found
