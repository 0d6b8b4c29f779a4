"""JSON kept as text, as Column expressions. Text that is no JSON gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Keys that name a job in a line, the first that holds something.
SUMMARY_KEYS = ["title", "url", "uri", "path", "document_id"]


def text_array(c: Column) -> Column:
    """The strings of a JSON array, in order, repeats kept; items of other kinds and empty strings left out. Text that is no
    array gives none."""
    items = F.when(F.regexp_like(c, F.lit(r"^\s*\[")), F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"))
    strings = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.filter(F.coalesce(strings, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != ""))


def payload_summary(c: Column) -> Column:
    """The first of the summary keys whose value isn't empty, false or 0; else empty."""
    found = [F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in SUMMARY_KEYS]
    return F.coalesce(*[F.when(~f.isin("false", "0", "null", "[]", "{}"), f) for f in found], F.lit(""))


def decoded(c: Column) -> Column:
    """The text as a variant; null where it is no JSON."""
    return F.try_parse_json(c)


def topics(items: Column) -> Column:
    """Stripped, blank ones out, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: strip(x)), lambda t: t != ""))


def first_text(c: Column, paths: list[str]) -> Column:
    """The first path that holds text."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, p), F.lit("")) for p in paths])


def isbn(c: Column) -> Column:
    """Of a volume's identifiers (array<struct<type, identifier>>): ISBN_13, else ISBN_10."""
    of = lambda kind: F.get(F.filter(c, lambda x: x["type"] == kind), F.lit(0))["identifier"]
    return F.coalesce(of("ISBN_13"), of("ISBN_10"))


def isbn_by_length(c: Column) -> Column:
    """Of an array of ISBNs: the first of 13 digits, else the first of 10."""
    return F.coalesce(F.get(F.filter(c, lambda x: F.length(x) == 13), F.lit(0)), F.get(F.filter(c, lambda x: F.length(x) == 10), F.lit(0)))


def year_of(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def director(crew: Column) -> Column:
    """Of array<struct<job, name>>: the first director."""
    return F.get(F.filter(crew, lambda x: x["job"] == "Director"), F.lit(0))["name"]


def description(c: Column) -> Column:
    """A description that is text, or an object whose value is text."""
    return F.coalesce(F.get_json_object(c, "$.description.value"), F.when(~F.get_json_object(c, "$.description").startswith("{"), F.get_json_object(c, "$.description")))


def only_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(keys))


def reject_reason_known(c: Column, prefixes: list[str]) -> Column:
    return F.regexp_like(F.lower(c), F.lit("^(" + "|".join(prefixes) + ")"))
