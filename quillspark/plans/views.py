"""The driver's tables under the engine's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

KINDS = ["ingest_library", "ingest_article", "ingest_podcast", "ingest_capture", "classify_book"]


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """events as a job table: k of the payload gives kind and durations, the event's type gives the status."""
    return as_jobs(table(spark, folder, "events"))


def as_jobs(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), k % len(KINDS))
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("complete")
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n, F.lit(0))
    out = e.select(F.col("event_id").alias("job_id"), kind.alias("kind"), status.alias("status"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), k.alias("k"), F.col("user_id"))
    started = F.when(F.col("status") != "queued", F.col("created_at") + minutes(F.lit(1)))
    ended = F.when(F.col("status").isin("complete", "failed"), F.col("created_at") + minutes(F.col("k") + 1))
    return out.withColumn("started_at", started).withColumn("completed_at", ended)


#: The same in SQL.
JOBS_SQL = """jobs AS (SELECT *, CASE WHEN status <> 'queued' THEN created_at + INTERVAL 1 MINUTE END AS started_at,
  CASE WHEN status IN ('complete', 'failed') THEN created_at + to_minutes(k + 1) END AS completed_at FROM (
  SELECT event_id AS job_id, ['ingest_library','ingest_article','ingest_podcast','ingest_capture','classify_book'][CAST(json_extract_string(props, '$.k') AS INT) % 5 + 1] AS kind,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'complete' END AS status,
  props AS payload, ts AS created_at, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id FROM events))"""

NOW = "2024-01-30 12:00:00"
