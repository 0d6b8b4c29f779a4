"""Corrections that users dictate, appended to Markdown, and their verdicts on what was shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

SECTION = "## Corrections"
VERDICTS = ["used", "ignored", "wrong"]
NEW_PROFILE = "# Profile\n\n## How to talk to me\n\n## What I'm sensitive about\n\n## How I think\n\n"
NEW_CORRECTIONS = "# Corrections\n\n"


def directive(correction: Column, day: Column) -> Column:
    """The line of a correction; null for a blank one."""
    return F.concat(F.lit("[directive, "), F.date_format(day, "yyyy-MM-dd"), F.lit("] "), F.nullif(strip(correction), F.lit("")))


def at_end(body: Column, line: Column) -> Column:
    """The line after the text, on a line of its own."""
    return F.concat(body, F.when((body == "") | F.endswith(body, F.lit("\n")), F.lit("")).otherwise(F.lit("\n")), line, F.lit("\n"))


def in_section(body: Column, line: Column, section: str = SECTION) -> Column:
    """The line at the end of the section, before the next heading of its level; without the section, one at the text's
    end."""

    def put(lines):
        starts = F.array_position(F.transform(lines, lambda x: strip(x)), section)
        rest = F.slice(lines, starts + 1, F.size(lines))
        stop = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda x: x.startswith("## ")), True), F.lit(0)) - 1, F.size(rest))
        joined = lambda part: F.array_join(part, "")
        return F.concat(joined(F.slice(lines, F.lit(1), starts)), joined(F.slice(rest, F.lit(1), stop)), line, F.lit("\n"), joined(F.slice(rest, stop + 1, F.size(rest))))

    lines = F.regexp_extract_all(body, F.lit("([^\n]*\n|[^\n]+$)"))
    held = F.array_contains(F.transform(lines, lambda x: strip(x)), section)
    gap = F.when(F.endswith(body, F.lit("\n")), F.lit("")).otherwise(F.lit("\n"))
    return F.when(held, let(lines, put)).otherwise(F.concat(body, gap, F.lit(f"{section}\n\n"), line, F.lit("\n")))


def corrected(asked: DataFrame, texts: DataFrame, day: Column) -> DataFrame:
    """Corrections applied: path, target_type, status, error, appended_directive, content.

    asked: target_type (profile, book, judge), path (of the text that it appends to), target_id, correction; texts: path,
    content, and for books a row of their folder with a null content. One correction of a text at a time. A blank
    correction, an unknown type and a book that isn't there are errors.
    """
    line = directive(F.col("correction"), day)
    met = asked.join(texts.select("path", "content", F.lit(True).alias("there")), "path", "left").withColumn("line", line)
    kind = F.col("target_type")
    error = F.when(~kind.isin("profile", "book", "judge"), "unknown target type").when(F.col("line").isNull(), "correction must not be blank").when((kind == "book") & (F.coalesce(strip("target_id"), F.lit("")) == ""), "slug must not be blank").when((kind == "book") & F.col("there").isNull(), "book not found")
    body = F.when(kind == "profile", in_section(F.coalesce("content", F.lit(NEW_PROFILE)), F.col("line"))).when(kind == "book", at_end(F.coalesce("content", F.lit(NEW_CORRECTIONS)), F.col("line"))).otherwise(at_end(F.coalesce("content", F.lit("")), F.col("line")))
    told = met.withColumn("error", error)
    good = F.col("error").isNull()
    return told.select("path", "target_type", F.when(good, "applied").otherwise("error").alias("status"), "error", F.when(good, F.col("line")).alias("appended_directive"), F.when(good, body).alias("content"))


def feedback(shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each verdict (invocation_id, verdict) whether it could be recorded, and else why not."""
    known = verdicts.join(shown.select("invocation_id", F.lit(True).alias("_known")).distinct(), "invocation_id", "left")
    error = F.when(~F.col("verdict").isin(VERDICTS), "invalid verdict").when(F.col("_known").isNull(), "no such invocation")
    return known.select("invocation_id", "verdict", error.isNull().alias("ok"), error.alias("error"))
