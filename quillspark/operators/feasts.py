"""The import of feasts, with references across traditions by slug."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_slug
from .dedupe import changed

KEY = ["primary_name", "tradition"]
#: What a new import may change, with the value that a missing one counts as.
MUTABLE = {"alternate_names": "[]", "calendar_type": None, "date_rule": None, "precedence": None, "theological_subjects": "[]", "source": "", "trial_use": 0}


def slugged(feasts: DataFrame) -> DataFrame:
    return feasts.withColumn("slug", ascii_slug(F.col("primary_name"), F.col("tradition")))


def slug_map(feasts: DataFrame, tradition: str) -> DataFrame:
    """slug, id of a tradition's feasts; of equal slugs the last id."""
    return slugged(feasts.filter(F.col("tradition") == tradition)).groupBy("slug").agg(F.max("id").alias("id"))


def classified(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """The entries with id (null for new ones) and action: new, updated or unchanged."""
    old = stored.select("id", *KEY, *[F.col(c).alias(f"_{c}") for c in MUTABLE])
    held = lambda name, c: c if MUTABLE[name] is None else F.coalesce(c, F.lit(MUTABLE[name]))
    differs = changed([(held(c, F.col(f"_{c}")), F.col(c)) for c in MUTABLE])
    met = entries.join(old, KEY, "left")
    return met.withColumn("action", F.when(F.col("id").isNull(), "new").when(differs, "updated").otherwise("unchanged")).drop(*[f"_{c}" for c in MUTABLE])


def imported(entries: DataFrame, stored: DataFrame, first_id: int) -> DataFrame:
    """The classified entries, new ones with ids from first_id on in the order of their position, and the id that their
    reference (cross_tradition_equivalent, a slug within this import) names, with whether it couldn't be resolved."""
    told = classified(entries, stored)
    # an import is a seed file's entries: few rows, numbered in one task
    fresh = told.filter("action = 'new'").withColumn("_new", F.row_number().over(Window.orderBy("position")) + first_id - 1).select(*KEY, "_new")
    ids = slugged(told.join(fresh, KEY, "left").withColumn("id", F.coalesce("id", "_new")).drop("_new"))
    by_slug = ids.groupBy("slug").agg(F.max_by("id", "position").alias("cross_tradition_equivalent_id")).withColumnRenamed("slug", "cross_tradition_equivalent")
    met = ids.join(by_slug, "cross_tradition_equivalent", "left")
    return met.withColumn("unresolved", F.col("cross_tradition_equivalent").isNotNull() & F.col("cross_tradition_equivalent_id").isNull())


def import_counts(result: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """One row: new, updated, unchanged, failed (references that couldn't be resolved, unless they are ignored)."""
    n = lambda c, name: F.count_if(c).alias(name)
    return result.agg(*[n(F.col("action") == a, a) for a in ("new", "updated", "unchanged")], n(F.lit(False) if ignore_missing else F.col("unresolved"), "failed"))


def anchored(units: DataFrame, feasts: DataFrame, filtering: bool = False) -> DataFrame:
    """Units (document_id, feast_id, ...) with their feast's name and tradition; only those that have one, when a search
    filters by feast."""
    names = feasts.select(F.col("id").alias("feast_id"), F.col("primary_name").alias("feast_name"), "tradition")
    return units.join(names, "feast_id", "inner" if filtering else "left")
