"""Expectations against hits, verdicts of replays, and matches of episodes in feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import episode_title, kind_matches, matcher_tokens, slug_tokens, title_overlaps


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of both with change lost, new or stayed; as sets."""
    a, b = before.distinct(), after.distinct()
    return a.exceptAll(b).withColumn("change", F.lit("lost")).union(b.exceptAll(a).withColumn("change", F.lit("new"))).union(a.intersect(b).withColumn("change", F.lit("stayed")))


def expected_hits(expected: DataFrame, accepted: DataFrame) -> DataFrame:
    """For each expectation (case_id, source_id, kind) the first accepted hit (case_id, candidate_id, position, source_type,
    genre, source_title) of the kind whose title shares enough tokens. Pairs meet through a shared token, so that no case
    is crossed with itself."""
    e = expected.withColumn("token", F.explode(slug_tokens(F.col("source_id"))))
    a = accepted.withColumn("token", F.explode(matcher_tokens(F.col("source_title"))))
    pairs = e.join(a, ["case_id", "token"]).drop("token").distinct()
    good = pairs.filter(kind_matches(F.col("source_type"), F.col("genre"), F.col("source_title"), F.col("kind")) & title_overlaps(F.col("source_title"), F.col("source_id")))
    order = Window.partitionBy("case_id", "source_id", "kind").orderBy("position", "candidate_id")
    return good.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("case_id", "source_id", "kind", "candidate_id", "position")


def verdicts(cases: DataFrame, matches: DataFrame, accepted: DataFrame) -> DataFrame:
    """By case: positive ones need a match, negative_true ones no hit at all, negative_spillover ones no liturgical hit."""
    m = matches.groupBy("case_id").agg(F.count("*").alias("matched"))
    h = accepted.groupBy("case_id").agg(F.count("*").alias("hits"), F.count_if(F.col("source_type") == "liturgical_unit").alias("liturgical"))
    met = cases.join(m, "case_id", "left").join(h, "case_id", "left").fillna(0, ["matched", "hits", "liturgical"])
    passed = F.when(F.col("category") == "positive", F.col("matched") > 0).when(F.col("category") == "negative_true", F.col("hits") == 0).otherwise(F.col("liturgical") == 0)
    return met.withColumn("passed", passed)


def feed_match(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """For each wanted title (feed, wanted_id, title) the item of its feed (feed, position, title, enclosure): the first of
    equal normalised title, else the first of which one title holds the other."""
    w = wanted.select("feed", "wanted_id", episode_title(F.col("title")).alias("want"))
    i = items.select("feed", "position", "enclosure", episode_title(F.col("title")).alias("have"))
    one = i.groupBy("feed", "have").agg(F.min_by(F.struct("position", "enclosure"), "position").alias("item"))
    same = w.join(one.withColumnRenamed("have", "want"), ["feed", "want"]).select("wanted_id", "item", F.lit(0).alias("tier"))
    rest = w.join(same.select("wanted_id"), "wanted_id", "left_anti")
    # one title can only hold the other if it holds the other's words inside: all but its first and last
    token = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    inner = lambda c: F.when(F.size(F.split(c, " ")) > 2, F.get(F.split(c, " "), F.lit(1)))
    long_w, long_i = rest.withColumn("inner", inner(F.col("want"))), one.withColumn("inner", inner(F.col("have")))
    holds = F.contains("have", "want") | F.contains("want", "have")
    pairs = [
        long_w.filter("inner IS NOT NULL").join(one.withColumn("inner", token(F.col("have"))), ["feed", "inner"]),
        rest.withColumn("inner", token(F.col("want"))).join(long_i.filter("inner IS NOT NULL"), ["feed", "inner"]),
        # titles of one or two words may stand inside other words
        long_w.filter("inner IS NULL").join(one, "feed"),
        rest.join(long_i.filter("inner IS NULL"), "feed"),
    ]
    part = [p.filter(holds).select("wanted_id", "item", F.lit(1).alias("tier")) for p in pairs]
    met = same.union(part[0]).union(part[1]).union(part[2]).union(part[3])
    best = met.groupBy("wanted_id").agg(F.min(F.struct("tier", "item.position", "item")).alias("best"))
    return best.select("wanted_id", "best.item.position", "best.item.enclosure", "best.tier")
