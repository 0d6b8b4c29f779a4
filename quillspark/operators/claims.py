"""A queue whose jobs are claimed by many workers at once: events in a table of commits, and optimistic concurrency.

A worker reads a version, works out what it wants to append and commits that as the next version. If another one was faster
it reads again, so every event is true of the version before it: no job is given to two workers. A claim is a lease; when it
has run out, the job is free again, whatever became of its worker.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.commits import Commits, Snapshot
from .jobs import TERMINAL

TABLE = "job_events"
EVENTS = "job_id bigint, kind string, payload string, created_at timestamp, status string, attempts int, claimer string, lease_until timestamp, error string, version bigint"


class Busy(RuntimeError):
    """Others have been faster every time."""


def state(events: DataFrame) -> DataFrame:
    """Each job's last event."""
    rest = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*rest), "version").alias("e")).select("job_id", "e.*")


def current(log: Commits, at: Snapshot | None = None) -> DataFrame:
    return state(log.frame(TABLE, EVENTS, at))


def _appended(log: Commits, make: Callable[[DataFrame], DataFrame], tries: int) -> DataFrame:
    """make(jobs) as the next version's events: rows of EVENTS but the version. Returns the events; an empty result isn't
    committed."""
    for _ in range(tries):
        base = log.snapshot()
        new = make(current(log, base)).withColumn("version", F.lit(base.version + 1).cast("bigint"))
        path = log.written(TABLE, new.select(*(c.split()[0] for c in EVENTS.split(", "))))
        rows = log.spark.read.schema(EVENTS).parquet(path)
        if rows.isEmpty() or log.commit(base, {TABLE: path}):
            return rows
    raise Busy(f"not committed in {tries} tries")


def submit(log: Commits, jobs: DataFrame, tries: int = 100) -> DataFrame:
    """New jobs (job_id, kind, payload, created_at) as events; ids that are known already are left out, and so are null ones.
    Of several rows with one id the first by created_at and kind counts."""
    first = jobs.filter("job_id IS NOT NULL").groupBy("job_id").agg(F.min(F.struct("created_at", "kind", "payload")).alias("j")).select("job_id", "j.*")
    none = {"attempts": F.lit(0), "claimer": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string"), "status": F.lit("queued")}
    return _appended(log, lambda known: first.join(known.select("job_id"), "job_id", "left_anti").withColumns(none), tries)


def claim(log: Commits, claimer: str, n: int, now: dt.datetime, lease: dt.timedelta, kinds: list[str] | None = None, tries: int = 100) -> DataFrame:
    """Up to n of the oldest jobs that wait, or whose lease has run out, as events of the claimer: running, with one attempt
    more, until now + lease. An empty result if there are none."""
    stamp = F.lit(now).cast("timestamp")

    def make(jobs: DataFrame) -> DataFrame:
        free = jobs.filter((F.col("status") == "queued") | (F.col("status") == "running") & (F.col("lease_until") <= stamp))
        free = free.filter(F.col("kind").isin(kinds)) if kinds is not None else free
        head = free.orderBy("created_at", "job_id").limit(n)
        return head.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "claimer": F.lit(claimer), "lease_until": F.lit(now + lease).cast("timestamp"), "error": F.lit(None).cast("string")})

    return _appended(log, make, tries)


def settle(log: Commits, claimer: str, results: DataFrame, tries: int = 100) -> DataFrame:
    """Results (job_id, status, error) of jobs that the claimer still holds, as events; those of jobs that went to another
    one, or ended, are left out. status: complete, failed, cancelled, or queued for one that goes back. Of several results of
    one job the first by status counts."""
    told = results.filter(F.col("status").isin(*TERMINAL, "queued")).groupBy("job_id").agg(F.min(F.struct("status", "error")).alias("r"))

    def make(jobs: DataFrame) -> DataFrame:
        mine = jobs.filter((F.col("status") == "running") & (F.col("claimer") == claimer)).join(told, "job_id")
        back = F.col("r.status") == "queued"
        return mine.withColumns({"status": F.col("r.status"), "error": F.col("r.error"), "claimer": F.when(~back, F.col("claimer")), "lease_until": F.lit(None).cast("timestamp")}).drop("r")

    return _appended(log, make, tries)


def renew(log: Commits, claimer: str, now: dt.datetime, lease: dt.timedelta, tries: int = 100) -> DataFrame:
    """All running jobs of the claimer whose lease hasn't run out, until now + lease."""
    stamp = F.lit(now).cast("timestamp")
    mine = lambda jobs: jobs.filter((F.col("status") == "running") & (F.col("claimer") == claimer) & (F.col("lease_until") > stamp))
    return _appended(log, lambda jobs: mine(jobs).withColumn("lease_until", F.lit(now + lease).cast("timestamp")), tries)
