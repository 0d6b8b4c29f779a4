"""Registered queries of the calendar: the years and days are those of orders, the feasts are made of the sizes of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import calendar
from ..session import checkpointed
from ..sources.readers import table
from .catalog import query


def _days(spark, folder):
    return table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


def _years(spark, folder):
    return table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def _feasts(spark, folder):
    """A feast for each size of a part: its rule, tradition and precedence follow from the size."""
    s = F.col("p_size")
    date = F.concat(F.lpad((s % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s * 3 % 31 + 1).cast("string"), 2, "0"))
    moved = F.when(s % 20 == 4, F.concat(F.lit("advent_1+"), (s % 23).cast("string"))).when(s % 20 == 9, F.lit("fourth_thursday_of_november")).when(s % 20 == 14, F.concat(F.lit("sunday_on_or_after_"), date)).otherwise("first_sunday_after_01-06")
    rule = F.when(s % 5 == 0, F.concat(F.lit("easter"), F.format_string("%+d", (s * 7 % 60 - 46).cast("int")))).when(s % 5 == 4, moved).otherwise(date)
    kind = F.when(s % 5 == 2, "commemoration").when((s % 5 == 0) | (s % 5 == 4), "movable").otherwise("fixed")
    ranks = F.when(s % 4 == 0, "principal_feast").when(s % 4 == 1, "holy_day").when(s % 4 == 2, "lesser_commemoration").otherwise("ferial")
    made = table(spark, folder, "part").groupBy("p_size").agg(F.min("p_name").alias("primary_name"))
    return made.select(s.cast("bigint").alias("id"), "primary_name", F.when(s % 11 == 0, "byzantine").otherwise("anglican").alias("tradition"), kind.alias("calendar_type"), rule.alias("date_rule"), ranks.alias("precedence"))


_FEASTS_SQL = """f AS (SELECT CAST(s AS BIGINT) AS id, primary_name, CASE WHEN s % 11 = 0 THEN 'byzantine' ELSE 'anglican' END AS tradition, CASE WHEN s % 5 = 2 THEN 'commemoration' WHEN s % 5 IN (0, 4) THEN 'movable' ELSE 'fixed' END AS calendar_type,
CASE WHEN s % 5 = 0 THEN 'easter' || printf('%+d', s * 7 % 60 - 46) WHEN s % 20 = 4 THEN 'advent_1+' || s % 23 WHEN s % 20 = 9 THEN 'fourth_thursday_of_november' WHEN s % 20 = 14 THEN 'sunday_on_or_after_' || md WHEN s % 5 = 4 THEN 'first_sunday_after_01-06' ELSE md END AS date_rule,
CASE s % 4 WHEN 0 THEN 'principal_feast' WHEN 1 THEN 'holy_day' WHEN 2 THEN 'lesser_commemoration' ELSE 'ferial' END AS precedence, md, s FROM (SELECT p_size AS s, min(p_name) AS primary_name, printf('%02d-%02d', p_size % 12 + 1, p_size * 3 % 31 + 1) AS md FROM part GROUP BY 1))"""
# both Easters of each year by other formulas than the engine's
_EASTER_SQL = """y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders),
e1 AS (SELECT *, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM y), e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h, (19 * a + 15) % 30 AS d FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l, (2 * (year % 4) + 4 * (year % 7) - d + 34) % 7 AS e FROM e2), e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS w FROM e3),
e AS (SELECT year, make_date(year, w // 31, w % 31 + 1) AS western, make_date(year, (d + e + 114) // 31, (d + e + 114) % 31 + 1) + 13 AS orthodox FROM e4),
v AS (SELECT year, 'anglican' AS tradition, western AS easter FROM e UNION ALL SELECT year, 'byzantine', orthodox FROM e)"""
_DATED_SQL = _FEASTS_SQL + ", " + _EASTER_SQL + """,
adv AS (SELECT year, make_date(year, 11, 27) + CAST((7 - dayofweek(make_date(year, 11, 27))) % 7 AS INT) AS advent FROM y),
fd AS (SELECT f.*, v.year, v.easter, CASE WHEN calendar_type <> 'movable' THEN try_cast(v.year || '-' || date_rule AS DATE) WHEN s % 5 = 0 THEN easter + (s * 7 % 60 - 46) WHEN s % 20 = 4 THEN advent + s % 23
  WHEN s % 20 = 9 THEN make_date(v.year, 11, 1) + CAST((4 - dayofweek(make_date(v.year, 11, 1)) + 7) % 7 + 21 AS INT) WHEN s % 20 = 14 THEN try_cast(v.year || '-' || md AS DATE) + CAST((7 - dayofweek(try_cast(v.year || '-' || md AS DATE))) % 7 AS INT)
  ELSE make_date(v.year, 1, 6) + CAST(7 - dayofweek(make_date(v.year, 1, 6)) AS INT) END AS day FROM f JOIN v USING (tradition) JOIN adv ON adv.year = v.year)"""


# the years of orders and all those of the two centuries; the calendars part by a day more in 2100
_ALL_EASTERS_SQL = _EASTER_SQL.replace("FROM orders)", "FROM orders UNION SELECT CAST(unnest(range(1900, 2101)) AS INT))").replace("+ 13 AS orthodox", "+ CAST(b - b // 4 - 2 AS INT) AS orthodox")


@query(f"WITH {_ALL_EASTERS_SQL} SELECT year, western, orthodox FROM e")
def easter_dates(spark, folder):
    """Both Easters of every year from 1900 to 2100 and of every year with an order."""
    years = _years(spark, folder).union(spark.range(1900, 2101).select(F.col("id").cast("int").alias("year"))).distinct()
    return years.select("year", dates.western_easter(F.col("year")).alias("western"), dates.orthodox_easter(F.col("year")).alias("orthodox"))


@query(f"WITH {_DATED_SQL} SELECT id, date_rule AS rule, tradition, year, day FROM fd WHERE calendar_type = 'movable'")
def movable_rules(spark, folder):
    """Every movable rule in every year with an order."""
    rules = checkpointed(_feasts(spark, folder).filter("calendar_type = 'movable'").select("id", F.col("date_rule").alias("rule"), "tradition"))
    found = calendar.resolved(rules.select("rule", "tradition").distinct().crossJoin(F.broadcast(_years(spark, folder))))
    return rules.join(found, ["rule", "tradition"]).select("id", "rule", "tradition", "year", "day")


@query(f"""WITH {_DATED_SQL}, r AS (SELECT *, CASE WHEN precedence = 'principal_feast' THEN 1 WHEN precedence = 'holy_day' AND calendar_type = 'fixed' AND date_rule IN ('01-01', '02-02', '08-06') AND dayofweek(day) = 0 THEN 2 WHEN precedence = 'holy_day' THEN 4 WHEN precedence = 'lesser_commemoration' THEN 5 ELSE 6 END AS rank FROM fd WHERE day IS NOT NULL AND year(day) = year)
SELECT year, tradition, day, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year, tradition, day ORDER BY rank, date_rule, id) AS n FROM r) WHERE n = 1""")
def precedence_winner(spark, folder):
    return calendar.winners(calendar.dated(_feasts(spark, folder), _years(spark, folder))).select("year", "tradition", "day", "id", "rank")


@query()
def year_calendar(spark, folder):
    """A calendar with transfers for every year with an order."""
    return calendar.year_calendar(_feasts(spark, folder), _years(spark, folder))


@query(f"""WITH {_EASTER_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, tradition, easter - 46 AS ash_wednesday, easter - 7 AS palm_sunday, easter - 1 AS holy_saturday, easter + 6 AS easter_saturday, easter + 8 AS week_after_second_sunday, day BETWEEN easter - 7 AND easter - 1 AS in_holy_week, day BETWEEN easter AND easter + 6 AS in_easter_week FROM d JOIN v ON v.year = year(day)""")
def season_dates(spark, folder):
    """The dates around both Easters for every day with an order, and whether the day is in Holy Week or Easter Week."""
    each = _days(spark, folder).withColumn("tradition", F.explode(F.array(F.lit("anglican"), F.lit("byzantine"))))
    s = each.withColumn("s", dates.season(dates.easter(F.year("day"), F.col("tradition"))))
    weeks = [F.col("day").between(F.col("s.palm_sunday"), F.col("s.holy_saturday")).alias("in_holy_week"), F.col("day").between(F.col("s.easter"), F.col("s.easter_saturday")).alias("in_easter_week")]
    return s.select("day", "tradition", "s.ash_wednesday", "s.palm_sunday", "s.holy_saturday", "s.easter_saturday", "s.week_after_second_sunday", *weeks)


@query(f"""WITH {_DATED_SQL}, b AS (SELECT CAST(year(o_orderdate) AS INT) AS year, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1)
SELECT id, year, day FROM fd JOIN b USING (year) WHERE day BETWEEN first AND last AND (calendar_type <> 'movable' OR s % 5 = 0)""")
def feasts_in_range(spark, folder):
    """Feasts by the short grammar between each year's first and last order."""
    day = F.to_date("o_orderdate")
    years = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    every = _feasts(spark, folder).crossJoin(F.broadcast(years))
    return calendar.in_range(every, F.col("year"), F.col("first"), F.col("last")).select("id", "year", "day")


@query(f"""WITH {_EASTER_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT day, western AS e, make_date(year, 11, 27) + CAST((7 - dayofweek(make_date(year, 11, 27))) % 7 AS INT) AS advent FROM d JOIN e ON e.year = year(day))
SELECT day, dayofweek(day) = 0 AND (day BETWEEN e - 46 AND e + 49 OR day BETWEEN advent AND make_date(year(day), 12, 24)) AS in_season FROM a""")
def sundays_of_seasons(spark, folder):
    return _days(spark, folder).select("day", dates.sunday_of_seasons(F.col("day"), dates.western_easter(F.year("day"))).alias("in_season"))


@query(f"""WITH {_DATED_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT id, d.day FROM fd JOIN d ON d.day = fd.day WHERE tradition = 'anglican' AND (calendar_type = 'fixed' OR calendar_type = 'movable' AND s % 5 = 0)""")
def feasts_on_days(spark, folder):
    """Feasts of every day with an order, fixed ones and those that go by Easter."""
    return calendar.on_days(_feasts(spark, folder), _days(spark, folder), "anglican").select("id", "day")
