"""First-wins dedupe on one key or two, upserts as new snapshots, fuzzy matches and greedy near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, match_key, words
from ..session import checkpointed


def first_of_key(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the smallest `order` of each key; rows without a key all stay."""
    held = rows.withColumn("_key", key)
    best = held.filter("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"))
    kept = held.join(best, "_key").filter(F.col(order) == F.col("_first")).drop("_first")
    return kept.unionByName(held.filter("_key is null")).drop("_key")


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't stored yet."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def insert_ignore(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stored rows and, of the new ones, the first of each key that isn't stored."""
    new = absent(rows, stored, keys)
    best = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return stored.unionByName(best, allowMissingColumns=True)


def two_key_first_wins(rows: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Rows taken in order, each unless a row taken before has its key_a or its key_b. A row that isn't taken claims nothing.

    Each round takes the rows that come first for both of their keys among those left, and drops the rows that share a key
    with them; so only keys travel, and no group is gathered: the first of a key is found where its rows are, and joined
    back. Null keys clash with nothing.
    """
    left = rows.select(order, key_a, key_b)
    taken = None
    while True:
        first = lambda key: left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
        both = left
        for key in (key_a, key_b):
            both = both.join(first(key), [key, order], "left_semi").unionByName(both.filter(F.col(key).isNull()))
        won = checkpointed(both.select(order, key_a, key_b))
        taken = won.select(order) if taken is None else taken.union(won.select(order))
        left = left.join(won.select(order), order, "left_anti").join(won.select(key_a), key_a, "left_anti").join(won.select(key_b), key_b, "left_anti")
        left = checkpointed(left)
        if left.isEmpty():
            return rows.join(taken, order, "left_semi")


def last_of_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last writer wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert_actions(stored: DataFrame, rows: DataFrame, key: str, hash_col: str) -> DataFrame:
    """The new rows with action insert, update or skip, by key and content hash."""
    old = stored.select(key, F.col(hash_col).alias("_old"))
    met = rows.join(old, key, "left")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col(hash_col), "skip").otherwise("update")
    return met.withColumn("action", action).drop("_old")


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether some pair differs; nulls are equal."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out


def filled(stored: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored, with the patch's values where it has some."""
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    met = stored.join(new, key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def resolved_ids(rows: DataFrame, by_source: DataFrame, by_hash: DataFrame, source_key: str, hash_key: str) -> DataFrame:
    """The id a row already has: by its source, else by its hash."""
    a = by_source.select(source_key, F.col("id").alias("_by_source"))
    b = by_hash.select(hash_key, F.col("id").alias("_by_hash"))
    return rows.join(a, source_key, "left").join(b, hash_key, "left").withColumn("resolved_id", F.coalesce("_by_source", "_by_hash")).drop("_by_source", "_by_hash")


def fuzzy_best(wanted: DataFrame, stored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each wanted row (wanted_id, title, author) the best stored one (id, title, author): the Jaccard similarity of
    the titles' words is at least the threshold; with both authors the score is 0.7 title + 0.3 author; ties to the
    smaller id.

    Two titles that similar share one of a title's rarest words: of n words, all but ceil(threshold * n) - 1. Only these
    words are joined, so that common words make no pairs.
    """
    toks = lambda c: F.array_sort(F.array_distinct(words(match_key(c))))
    w = wanted.select("wanted_id", toks(F.col("title")).alias("w_title"), toks(F.col("author")).alias("w_author"))
    # of stored rows with the same words only the smallest id can be the best; titles with the same words are one
    s = stored.select("id", toks(F.col("title")).alias("s_title"), toks(F.col("author")).alias("s_author")).groupBy("s_title", "s_author").agg(F.min("id").alias("id"))
    titles = [frame.select(F.col(c).alias("title")).distinct() for frame, c in ((w, "w_title"), (s, "s_title"))]
    frequency = titles[0].unionAll(titles[1]).select(F.explode("title").alias("word")).groupBy("word").agg(F.count("*").alias("df"))

    def rarest(frame: DataFrame) -> DataFrame:
        of = frame.select("title", F.size("title").alias("n"), F.explode("title").alias("word")).join(frequency, "word")
        order = Window.partitionBy("title").orderBy("df", "word")
        return of.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("title", "word", "n")

    a, b = rarest(titles[0]).withColumnRenamed("title", "w_title"), rarest(titles[1]).withColumnsRenamed({"title": "s_title", "n": "m"})
    alike = (F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold - 1e-9))
    t, au = jaccard(F.col("w_title"), F.col("s_title")), jaccard(F.col("w_author"), F.col("s_author"))
    pairs = a.join(b, "word").filter(alike).select("w_title", "s_title").distinct().withColumn("title_score", t).filter(F.col("title_score") >= threshold)
    # authors meet under their titles, each pair of them once
    authors = w.select("w_title", "w_author").distinct().join(pairs, "w_title").join(s, "s_title")
    score = F.when((F.size("w_author") > 0) & (F.size("s_author") > 0), 0.7 * F.col("title_score") + 0.3 * au).otherwise(F.col("title_score"))
    best = authors.withColumn("score", score).groupBy("w_title", "w_author").agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("best"))
    found = w.join(best, ["w_title", "w_author"]).groupBy("wanted_id").agg(F.min("best").alias("best"))
    return found.select("wanted_id", "best.id", (-F.col("best.less")).alias("score"))


def greedy_distinct(rows: DataFrame, group: str, order: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Of each group's texts in order, those whose word sets are less similar than the threshold to all kept before; texts
    without words are left out. (group, order) is unique.

    Texts meet only through their rarest words, as in fuzzy_best, and similar ones make an edge from the earlier to the later.
    Then in each round a text that no undecided one comes before is kept, and what it has an edge to is left out: no group
    is gathered, and only edges travel.
    """
    own = rows.select(group, order, text).withColumn("_w", F.array_distinct(words(F.lower(text)))).filter(F.size("_w") > 0)
    n = F.size("_w")
    frequency = own.select(F.explode("_w").alias("_x")).groupBy("_x").agg(F.count("*").alias("_df"))
    each = own.select(group, order, n.alias("_n"), F.explode("_w").alias("_x")).join(frequency, "_x")
    rarest = each.withColumn("_k", F.row_number().over(Window.partitionBy(group, order).orderBy("_df", "_x"))).filter(F.col("_k") <= F.col("_n") - F.ceil(F.col("_n") * F.lit(threshold) - 1e-9) + 1)
    a, b = (rarest.select(group, "_x", F.col(order).alias(f"_{side}"), F.col("_n").alias(f"_n{side}")) for side in "ab")
    alike = (F.col("_a") < F.col("_b")) & (F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(threshold - 1e-9))
    near = a.join(b, [group, "_x"]).filter(alike).select(group, "_a", "_b").distinct()
    sets = lambda side: own.select(group, F.col(order).alias(f"_{side}"), F.col("_w").alias(f"_w{side}"))
    met = near.join(sets("a"), [group, "_a"]).join(sets("b"), [group, "_b"])
    edges = checkpointed(met.filter(jaccard(F.col("_wa"), F.col("_wb")) >= threshold).select(group, "_a", "_b"))
    gone = None
    while not edges.isEmpty():
        later = edges.select(group, F.col("_b").alias("_a")).distinct()
        kept = edges.select(group, "_a").distinct().join(later, [group, "_a"], "left_anti")
        out = checkpointed(edges.join(kept, [group, "_a"], "left_semi").select(group, F.col("_b").alias(order)).distinct())
        gone = out if gone is None else gone.union(out)
        for side in ("_a", "_b"):
            edges = edges.join(out.withColumnRenamed(order, side), [group, side], "left_anti")
        edges = checkpointed(edges.join(kept, [group, "_a"], "left_anti"))
    plain = own.select(group, order, text)
    return plain if gone is None else plain.join(gone, [group, order], "left_anti")
