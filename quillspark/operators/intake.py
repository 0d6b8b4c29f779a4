"""Jobs as events that are appended, and the step that cuts, embeds and writes documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .chunks import chunks

#: A job's kind has this many characters at most.
LONGEST_KIND = 64
ACTIVE = ["queued", "running"]


def submitted(asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Requests (job_id, kind, payload as JSON) as events of new jobs, and those that aren't valid, with the reason."""
    why = (
        F.when(F.col("kind").isNull() | (strip(F.col("kind")) == ""), "kind must not be empty")
        .when(F.length("kind") > LONGEST_KIND, f"kind must have {LONGEST_KIND} characters at most")
        .when(~F.coalesce(F.startswith(F.trim("payload"), F.lit("{")) & F.try_parse_json("payload").isNotNull(), F.lit(False)), "payload must be a JSON object")
    )
    judged = asked.withColumn("reason", why)
    events = judged.filter("reason IS NULL").select("job_id", "kind", "payload", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    return events, judged.filter("reason IS NOT NULL").select("job_id", "kind", "reason")


def cancelled(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """For each request (job_id): previous_status (null for an unknown job), whether it is cancelled, and when: only jobs
    that wait or run are."""
    held = asked.select("job_id").distinct().join(jobs.select("job_id", F.col("status").alias("previous_status")), "job_id", "left")
    ends = F.coalesce(F.col("previous_status").isin(ACTIVE), F.lit(False))
    return held.withColumn("cancelled", ends).withColumn("completed_at", F.when(ends, now))


def payload(**fields: Column) -> Column:
    """A job's payload as JSON, with the fields that aren't null."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def in_flight(jobs: DataFrame, kinds: Column, field: str) -> DataFrame:
    """The values of a payload's field in jobs that wait or run."""
    return jobs.filter(kinds & F.col("status").isin(ACTIVE)).select(F.get_json_object("payload", f"$.{field}").alias(field)).filter(F.col(field).isNotNull()).distinct()


def of_kind(prefix: str) -> Column:
    """Kinds that begin so; an underscore stands for any character, as in SQL."""
    return F.col("kind").like(f"{prefix}%")


def embedded(documents: DataFrame, stored: DataFrame, embed: Callable[[Column], Column], cut: Callable[[Column], Column] = chunks, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of the documents that have none stored: document_id, chunk_index, text, token_count, embedding.

    documents: document_id, text, and what `shown` reads; stored: document_id. `shown` gives the text that is embedded for a
    chunk's text, where it isn't the chunk itself; `cut` the chunks (array<struct<text, token_count>>) of a text or another
    column.
    """
    new = documents.join(stored.select("document_id").distinct(), "document_id", "left_anti")
    each = new.select("*", F.posexplode(cut(F.col("text"))).alias("chunk_index", "chunk")).withColumn("_shown", F.col("chunk.text") if shown is None else shown(F.col("chunk.text")))
    return each.select("document_id", "chunk_index", "chunk.text", "chunk.token_count", embed(F.col("_shown")).alias("embedding"))


def embed_results(documents: DataFrame, pieces: DataFrame, model: str) -> DataFrame:
    """By document: chunk_count, total_tokens and the model; documents without a chunk have none of them, and are done too."""
    counted = pieces.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("total_tokens"))
    met = documents.select("document_id").join(counted, "document_id", "left").fillna(0, ["chunk_count", "total_tokens"])
    return met.select("document_id", "chunk_count", "total_tokens", F.lit(model).alias("model"), F.lit("embedded").alias("status"))


def run_record(jobs: DataFrame, now: Column) -> DataFrame:
    """A watcher's run as one row: how many jobs it made of each kind, as JSON."""
    counts = jobs.groupBy("kind").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("made"))
    return counts.select(now.alias("at"), F.aggregate("made", F.lit(0).cast("bigint"), lambda a, m: a + m["n"]).alias("submitted"), F.to_json(F.map_from_entries("made")).alias("details"))


def dispatched(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """What the handlers make of the jobs of their kinds, and the jobs without a handler, which fail."""
    out = None
    for kind, handle in handlers.items():
        made = handle(jobs.filter(F.col("kind") == kind))
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    lost = jobs.filter(~F.col("kind").isin(*handlers)).withColumn("error", F.concat(F.lit("no handler for "), F.col("kind")))
    return out, lost


def caption_choice(manual: Column, auto: Column, declared: Column, good: Callable[[Column], Column]) -> Column:
    """struct<text, source>: manual captions where they are declared; otherwise the manual and then the automatic ones, as
    auto, if they are good enough; null where speech must be transcribed."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    one = lambda c, source: F.struct(some(c).alias("text"), F.lit(source).alias("source"))
    return F.when(declared & some(manual).isNotNull(), one(manual, "manual")).when(some(manual).isNotNull() & good(manual), one(manual, "auto")).when(some(auto).isNotNull() & good(auto), one(auto, "auto"))


def merged_text(transcript: Column, screens: Column) -> Column:
    """A transcript and the texts read from pictures, blank ones left out; null if nothing is there, which is an error."""
    parts = lambda every: F.filter(F.transform(every, lambda t: strip(t)), lambda t: t != "")
    return let(F.array_join(parts(F.concat(F.array(transcript), F.coalesce(screens, F.array().cast("array<string>")))), "\n\n"), lambda t: F.nullif(t, F.lit("")))


def summary_body(description: Column, points: Column, quotes: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(description), F.coalesce(points, none), F.coalesce(quotes, none)), "\n\n")
