"""The year's calendar: fixed and movable rules, precedence, and transfers."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MOVABLE_FORMS, easter, fixed_or_easter_rule, month_day, movable_form, precedence_rank
from ..session import checkpointed

RESOLVED = "year int, tradition string, day date, id bigint, primary_name string, precedence string, transferred boolean"


def resolved(rules: DataFrame) -> DataFrame:
    """rules (rule, tradition, year) with day, their date in the year; null for rules that aren't known and days that don't
    exist. Each form of rule is a projection of its own, as all of them in one are too large to be compiled."""
    named = rules.withColumn("form", movable_form(F.col("rule")))
    out = named.filter("form IS NULL").select("rule", "tradition", "year", F.lit(None).cast("date").alias("day"))
    for name, day in MOVABLE_FORMS.items():
        out = out.unionByName(named.filter(F.col("form") == name).select("rule", "tradition", "year", day(F.col("rule"), F.col("year"), easter(F.col("year"), F.col("tradition"))).alias("day")))
    return out


def dated(feasts: DataFrame, years: DataFrame) -> DataFrame:
    """Every feast in every year, with its own day; feasts that a year doesn't have are left out. years: year."""
    each = feasts.crossJoin(F.broadcast(years)).withColumn("easter", easter(F.col("year"), F.col("tradition")))
    fixed = F.when(F.col("calendar_type").isin("fixed", "commemoration") & F.regexp_like("date_rule", F.lit(r"^\d{2}-\d{2}$")), month_day(F.col("year"), F.col("date_rule")))
    # each rule of each year once, as feasts share rules
    rules = feasts.filter("calendar_type = 'movable'").select(F.trim("date_rule").alias("rule"), "tradition").distinct().crossJoin(F.broadcast(years))
    moved = checkpointed(resolved(rules).withColumnRenamed("day", "moved"))
    met = each.withColumn("rule", F.when(F.col("calendar_type") == "movable", F.trim("date_rule"))).join(moved, ["rule", "tradition", "year"], "left")
    return met.withColumn("day", F.coalesce(fixed, "moved")).drop("rule", "moved").filter(F.year("day") == F.col("year"))


def in_range(feasts: DataFrame, year: Column, first: Column, last: Column) -> DataFrame:
    """Feasts whose day by the short grammar lies between two dates, each by its own tradition's Easter."""
    return feasts.withColumn("day", fixed_or_easter_rule(F.col("date_rule"), year, F.col("tradition"))).filter(F.col("day").between(first, last))


def on_day(feasts: DataFrame, day: Column, tradition: str | None = None) -> DataFrame:
    """Fixed feasts of the day's month and day, and then the Easter rules that fall on it."""
    mine = feasts if tradition is None else feasts.filter(F.col("tradition") == tradition)
    fixed = mine.filter((F.col("calendar_type") == "fixed") & (F.col("date_rule") == F.date_format(day, "MM-dd")))
    rule = F.lit(tradition) if tradition else F.lit("anglican")
    moved = mine.filter(F.col("calendar_type") == "movable").filter(fixed_or_easter_rule(F.col("date_rule"), F.year(day), rule) == day)
    return fixed.unionByName(moved)


def on_days(feasts: DataFrame, days: DataFrame, tradition: str) -> DataFrame:
    """The tradition's feasts of each day (days: day): fixed feasts by month and day, and those whose rule is the day's
    distance from Easter. Both meet by equality, so that no feast is tried against every day."""
    mine = feasts.filter(F.col("tradition") == tradition)
    fixed = mine.filter("calendar_type = 'fixed'").join(days.select("day", F.date_format("day", "MM-dd").alias("date_rule")).distinct(), "date_rule")
    away = F.datediff("day", easter(F.year("day"), F.lit(tradition)))
    of_easter = mine.filter("calendar_type = 'movable'").withColumn("away", F.regexp_extract("date_rule", r"^easter([+-][0-9]+)$", 1).try_cast("int"))
    moved = of_easter.filter("away IS NOT NULL").join(days.select("day", away.alias("away")).distinct(), "away").drop("away")
    return fixed.unionByName(moved)


def winners(resolved: DataFrame) -> DataFrame:
    """Of the feasts of one day (year, tradition, day) the one of the best rank, then by rule, then by id."""
    rank = precedence_rank(F.col("precedence"), F.col("calendar_type"), F.col("date_rule"), F.col("day"))
    order = Window.partitionBy("year", "tradition", "day").orderBy("rank", "date_rule", "id")
    return resolved.withColumn("rank", rank).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def year_calendar(feasts: DataFrame, years: DataFrame) -> DataFrame:
    """One feast a day, with transfers. Where each goes depends on those placed before, at most a year's days in a group."""
    ranked = dated(feasts, years).withColumn("rank", precedence_rank(F.col("precedence"), F.col("calendar_type"), F.col("date_rule"), F.col("day")))
    rows = ranked.filter(F.col("precedence").isin("principal_feast", "holy_day", "lesser_commemoration")).select("year", "tradition", "day", "easter", "id", "primary_name", "precedence", "calendar_type", "date_rule", "rank")
    return rows.groupBy("year", "tradition").applyInPandas(_placed, RESOLVED)


def _placed(part: pd.DataFrame) -> pd.DataFrame:
    day = lambda n: dt.timedelta(days=n)
    part = part.sort_values(["day", "rank", "date_rule", "id"], kind="stable")
    paschal = part["easter"].iloc[0]
    holy, back = (paschal - day(7), paschal + day(6)), paschal + day(8)
    ashes = paschal - day(46)
    taken: dict[dt.date, object] = {}

    def open_from(d: dt.date) -> dt.date:
        while d.weekday() == 6 or d in taken:
            d += day(1)
        return d

    for row in part[part["precedence"] == "principal_feast"].itertuples():
        taken.setdefault(row.day, row)
    fasts = part[part["precedence"] == "holy_day"].sort_values(["day", "id"], kind="stable")
    for row in fasts.itertuples():
        fixed = row.calendar_type == "fixed"
        if fixed and holy[0] <= row.day <= holy[1]:
            taken[open_from(back)] = row
            continue
        to = row.day
        if fixed and to.weekday() == 6 and row.rank != 2:
            to = open_from(to + day(1))
        if to == ashes and row.date_rule != "easter-46":
            to = open_from(ashes + day(1))
        taken.setdefault(to, row)
    lesser = part[part["precedence"] == "lesser_commemoration"].sort_values(["day", "date_rule", "primary_name"], kind="stable")
    for row in lesser.drop_duplicates("day").itertuples():
        if holy[0] <= row.day <= holy[1]:
            to = open_from(back)
        elif row.day.weekday() == 6 or row.day in taken:
            to = open_from(row.day + day(1))
        else:
            to = row.day
        taken[to] = row
    found = sorted(taken.items())
    first = part.iloc[0]
    return pd.DataFrame([(first["year"], first["tradition"], d, r.id, r.primary_name, r.precedence, d != r.day) for d, r in found], columns=["year", "tradition", "day", "id", "primary_name", "precedence", "transferred"])
