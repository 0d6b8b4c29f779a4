"""Job and stage events: the current state as a fold of the log, zombies, purges and repair plans.

A log is append-only; a job's state is its last event, and a terminal state absorbs what comes later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["complete", "failed", "cancelled"]
# Seconds after which a running job of a kind counts as dead; others 1800.
THRESHOLDS = {
    "ingest_library": 5400,
    "ingest_audiobook": 900,
    "ingest_book_enrichment": 900,
    "ingest_movie": 900,
    "ingest_tv": 900,
    "ingest_article": 900,
    "ingest_podcast": 3600,
    "ingest_youtube": 3600,
    "ingest_image_url": 600,
    "ingest_pdf": 3600,
    "ingest_capture": 600,
    "ingest_bluesky_url": 300,
    "ingest_liturgy_bcp": 3600,
    "ingest_liturgy_lff": 3600,
    "classify_book": 300,
    "generate_book_note": 600,
    "regenerate_profile": 1800,
}
DEFAULT_THRESHOLD = 1800


def threshold(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(DEFAULT_THRESHOLD))


def current_state(events: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """By key: the first terminal status if there is one, else the last; how many events, the last error that was told."""
    at = F.struct(stamp, tie)
    ended = F.min_by(F.when(F.col("status").isin(TERMINAL), F.col("status")), F.when(F.col("status").isin(TERMINAL), at))
    return events.groupBy(key).agg(F.coalesce(ended, F.max_by("status", at)).alias("status"), F.count("*").alias("events"), F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"))


def stage_state(events: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """By job and stage: a stage that is complete stays so; the last payload that isn't null; how many attempts."""
    done = F.max(F.when(F.col("status") == "complete", F.lit("complete")))
    return events.groupBy(*keys).agg(F.coalesce(done, F.max_by("status", stamp)).alias("status"), F.max_by("payload", F.when(F.col("payload").isNotNull(), F.col(stamp))).alias("payload"), F.count_if(F.col("status") == "running").alias("attempts"))


def zombies(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs that started longer ago than their kind may take, or whose start can't be read."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return jobs.filter("status = 'running'").withColumn("age", age).withColumn("threshold", threshold(F.col("kind"))).filter(F.col("age").isNull() | (F.col("age") > F.col("threshold")))


def failed_events(dead: DataFrame, now: Column) -> DataFrame:
    """The events that end dead jobs."""
    return dead.select("job_id", "kind", F.lit("failed").alias("status"), F.concat(F.lit("zombie: running for "), F.col("age").cast("string"), F.lit(" s")).alias("error"), now.alias("event_ts"))


def queue_head(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'queued'").orderBy("created_at", "job_id").limit(1)


def next_status(attempts: Column, retryable: Column, circuit_open: Column, most: int = 3) -> Column:
    """What becomes of a job that didn't succeed: struct<status, attempts, error>. An open circuit isn't charged."""
    return (
        F.when(circuit_open, F.struct(F.lit("queued").alias("status"), F.greatest(F.lit(0), attempts - 1).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error")))
        .when(retryable & (attempts < most), F.struct(F.lit("queued").alias("status"), attempts.cast("int").alias("attempts"), F.lit(None).cast("string").alias("error")))
        .otherwise(F.struct(F.lit("failed").alias("status"), attempts.cast("int").alias("attempts"), F.when(retryable, F.lit("retry_exhausted")).alias("error")))
    )


def kept_jobs(jobs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Without terminal jobs that ended (or else began) more than `days` ago."""
    old = F.col("status").isin(TERMINAL) & (F.coalesce("completed_at", "created_at") < now - F.make_dt_interval(F.lit(days)))
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def kept_stages(stages: DataFrame, jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    ended = jobs.filter(F.col("status").isin(TERMINAL) & (F.col("completed_at") < now - F.make_dt_interval(F.lit(days))))
    return stages.join(ended.select("job_id"), "job_id", "left_anti")


def changed_pages(pages: DataFrame, stored: DataFrame, busy: DataFrame, key: str, stamp: str) -> DataFrame:
    """Pages never stored or edited since, that no job works on."""
    last = stored.groupBy(key).agg(F.max(stamp).alias("_stored"))
    return pages.join(last, key, "left").filter(F.col("_stored").isNull() | (F.col(stamp) > F.col("_stored"))).join(busy.select(key), key, "left_anti").drop("_stored")


def orphans(vectors: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    return vectors.join(chunks.select(key), key, "left_anti")


def repair_matches(documents: DataFrame, failed: DataFrame) -> DataFrame:
    """Documents without chunks with the newest failed job that names them: by path, by address or hash, by page id.

    documents: id, path, url, content_hash, page_id; failed: job_id, path, url, content_hash, page_id.
    """
    met = None
    for key in ("path", "url", "content_hash", "page_id"):
        of = documents.filter(F.col(key).isNotNull()).select("id", key).join(failed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("job_id").alias("job_id")), key).select("id", "job_id")
        met = of if met is None else met.union(of)
    return met.groupBy("id").agg(F.max("job_id").alias("job_id"))


def first_terminal(events: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(stamp, tie)
    return events.filter(F.col("status").isin(TERMINAL)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
