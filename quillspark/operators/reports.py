"""Reports over documents, jobs and subjects. Every relative time takes `now` from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import seconds_between
from ..functions.json import payload_summary, text_array


def progress(documents: DataFrame, kind: str, status: str) -> DataFrame:
    """Counts in total, by status and by type and status, in one pass: level is 3 for the total, 2 by status, 0 by both."""
    sets = documents.groupingSets([[], [F.col(status)], [F.col(kind), F.col(status)]], F.col(kind), F.col(status))
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n")).select("level", F.col(kind).alias("kind"), F.col(status).alias("status"), "n")


def counts_nested(documents: DataFrame, kind: str, status: str) -> DataFrame:
    """By type, a map from status to count."""
    each = documents.groupBy(kind, status).count()
    return each.groupBy(kind).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "count")))).alias("by_status"))


def oldest_pending(jobs: DataFrame) -> DataFrame:
    """The queued job that waits longest, ties to the smaller id."""
    return jobs.filter("status = 'queued'").orderBy("created_at", "job_id").limit(1)


def recent_completed(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.filter("status = 'complete'").orderBy(F.desc("completed_at"), F.desc("job_id")).limit(max(0, min(n, 20))).withColumn("summary", payload_summary(F.col("payload")))


def in_flight(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter("status = 'running'").withColumn("seconds", seconds_between(F.col("started_at"), now)).withColumn("summary", payload_summary(F.col("payload")))


def throughput(jobs: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Jobs that ended in the last `seconds` before now, by outcome."""
    ended = F.col("completed_at")
    recent = (ended > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))) & (ended <= now)
    return jobs.filter(recent & F.col("status").isin("complete", "failed")).groupBy("status").agg(F.count("*").alias("n"))


def health(jobs: DataFrame, now: Column) -> DataFrame:
    """Signals of decay in one row and one pass."""
    ago = lambda s: now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(s))
    return jobs.agg(
        F.max(F.when(F.col("status") == "complete", F.col("completed_at"))).alias("last_completed"),
        F.count_if((F.col("status") == "failed") & (F.col("completed_at") > ago(3600))).alias("failed_last_hour"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if((F.col("status") == "running") & (F.col("started_at") < ago(1800))).alias("running_long"),
        F.count("*").alias("jobs"),
    )


def subject_frequency(feasts: DataFrame, subjects: str, name: str, least: int = 1) -> DataFrame:
    """Subjects of JSON arrays: how often each occurs (repeats in one row count), the distinct names that have it, sorted,
    and whether it is from the controlled list or an `_other:` one; commonest first."""
    each = feasts.select(F.col(name).alias("name"), F.explode(text_array(F.col(subjects))).alias("subject"))
    counted = each.groupBy("subject").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("name")).alias("names"))
    return counted.filter(F.col("n") >= least).withColumn("controlled", ~F.col("subject").startswith("_other:")).orderBy(F.desc("n"), "subject")


def zero_filled(counts: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """Counts for every value of the domain."""
    return domain.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def counted_before(rows: DataFrame, key: str, groups: list[str], at: str, span: int, name: str) -> DataFrame:
    """key, and how many rows of its group lie at most `span` before it (itself and those at the same time among them).

    A group isn't gathered: time is cut into buckets of `span`, and a row's window lies in its own bucket and the one before.
    Each row counts for its own bucket and, as one that was before, for the next.
    """
    bucket = F.floor(F.col(at) / span).cast("bigint")
    cut = rows.select(key, *groups, F.col(at).alias("_at"), bucket.alias("_bucket"))
    both = cut.withColumn("_own", F.lit(True)).union(cut.select(key, *groups, "_at", F.col("_bucket") + 1, F.lit(False)))
    order = Window.partitionBy(*groups, "_bucket").orderBy("_at").rangeBetween(-span, 0)
    return both.withColumn(name, F.count("*").over(order)).filter("_own").select(key, name)


def repeated_failures(jobs: DataFrame, window_s: int = 600) -> DataFrame:
    """For each failure, how many failures of the same kind and payload ended in the window up to it."""
    failed = jobs.filter("status = 'failed'")
    ended = failed.withColumn("_ended", F.unix_micros(F.col("completed_at").cast("timestamp")))
    return failed.join(counted_before(ended, "job_id", ["kind", "payload"], "_ended", window_s * 1_000_000, "failures"), "job_id")


def distinct_labels(documents: DataFrame, label: Column, stamp: str, n: int) -> DataFrame:
    """The n labels seen last."""
    return documents.groupBy(label.alias("label")).agg(F.max(stamp).alias("last")).orderBy(F.desc("last"), "label").limit(n)


def recent(documents: DataFrame, kinds: list[str], kind: str, stamp: str, key: str, n: int) -> DataFrame:
    return documents.filter(F.col(kind).isin(kinds)).orderBy(F.desc(stamp), key).limit(n)


def corpus_sample(samples: dict[str, DataFrame], text: str) -> DataFrame:
    """One row with a list of texts for each sample; a sample is a bounded query of its own."""
    out = None
    for name, rows in samples.items():
        one = rows.agg(F.sort_array(F.collect_list(text)).alias(name))
        out = one if out is None else out.join(one)
    return out


def probe(vectors: DataFrame, liturgical: DataFrame, key: str, k: int = 100) -> DataFrame:
    """How the hits of one kind stand among the nearest: their ranks, the distance of the tenth hit and the best of theirs.
    vectors: key, distance; liturgical: key."""
    near = vectors.orderBy("distance", key).limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # of k rows
    told = ranked.join(F.broadcast(near.select(key).join(liturgical.select(key).distinct(), key).withColumn("own", F.lit(True))), key, "left")
    ranks = F.sort_array(F.collect_list(F.when(F.col("own"), F.col("rank"))))
    return told.agg(ranks.alias("ranks"), F.max(F.when(F.col("rank") == 10, F.col("distance"))).alias("tenth"), F.min(F.when(F.col("own"), F.col("distance"))).alias("best"))
