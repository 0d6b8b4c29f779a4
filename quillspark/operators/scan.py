"""Scans over ordered rows of a key: values carried forward, running totals, and finite-state machines.

A key's rows are cut into chunks by their places (0, 1, 2, ... in each key), a chunk being what one task takes at a time; what
the chunks before it come to is a row for each chunk. So a key of any length is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that are taken together.
CHUNK = 256


def carried_within(rows: DataFrame, key: str, at: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """What carried gives, for keys that each fit a task: one window, which a following one or a group by the key shares."""
    upto = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = {n: F.last(c, ignorenulls=True).over(upto) for n, c in (last or {}).items()}
    return rows.withColumns(told | {n: F.sum(F.coalesce(c, F.lit(0))).over(upto) for n, c in (total or {}).items()})


def carried(rows: DataFrame, key: str, at: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, chunk: int | Column = CHUNK) -> DataFrame:
    """rows with, for each name in `last`, the expression's last value that isn't null up to and with the row, and for each
    name in `total` the sum of the expression up to and with the row (nulls count as 0).

    A null key is a key of its own. Without rows the result is empty. chunk: places of a chunk, or else the row's chunk, where
    the rows of a chunk come together and `at` is their order in it.
    """
    last, total = last or {}, total or {}
    # in a struct a null key equals a null key, so that the rows that a window has put in order meet their chunks where they are
    made = rows.withColumn("_chunk", chunk if isinstance(chunk, Column) else F.floor(F.col(at) / chunk)).withColumn("_key", F.struct(F.col(key).alias("key")))
    made = made.withColumns({f"_own_{n}": c for n, c in {**last, **{n: F.coalesce(c, F.lit(0)) for n, c in total.items()}}.items()})
    own = lambda n: F.col(f"_own_{n}")
    sums = [F.max_by(own(n), F.when(own(n).isNotNull(), F.col(at))).alias(f"_of_{n}") for n in last] + [F.sum(own(n)).alias(f"_of_{n}") for n in total]
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda n: F.col(f"_of_{n}")
    ahead = [F.last(of(n), ignorenulls=True).over(before).alias(f"_before_{n}") for n in last] + [F.coalesce(F.sum(of(n)).over(before), F.lit(0)).alias(f"_before_{n}") for n in total]
    chunks = made.groupBy("_key", "_chunk").agg(*sums).select("_key", "_chunk", *ahead)
    inside = Window.partitionBy("_key", "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = {f"_own_{n}": F.last(own(n), ignorenulls=True).over(inside) for n in last} | {f"_own_{n}": F.sum(own(n)).over(inside) for n in total}
    met = made.withColumns(upto).join(chunks, ["_key", "_chunk"])
    told = {n: F.coalesce(own(n), F.col(f"_before_{n}")) for n in last} | {n: own(n) + F.col(f"_before_{n}") for n in total}
    return met.withColumns(told).select(*[c for c in rows.columns if c not in told], *told)


def composed(steps: Column, n_states: int) -> Column:
    """One transition (array of the state after each state) that does what an array of them does in order."""
    start = F.array(*map(F.lit, range(n_states)))
    return F.aggregate(steps, start, lambda f, s: F.transform(f, lambda x: F.get(s, x)))


def states(rows: DataFrame, key: str, at: str, step: Column, n_states: int, start: int = 0, chunk: int = CHUNK) -> DataFrame:
    """rows with `state`, the state before the row, of a machine that begins each key in `start`. step: the row's transition,
    an array with the state after each state.

    Transitions compose, so a chunk's rows come to one transition; those of the chunks are scanned the same way, chunks of
    chunks and so on, and give the state in which each chunk begins.
    """
    own = rows.withColumn("_step", step).withColumn("_chunk", F.floor(F.col(at) / chunk))
    lists = own.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_c")).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("place"), F.col("_step").alias("step")))).alias("steps"))
    longest = rows.agg(F.max(at)).first()[0]
    if longest is not None and longest >= chunk:
        whole = lists.select("_key", "_c", composed(F.transform("steps", lambda s: s["step"]), n_states).alias("step"))
        begun = states(whole.withColumnsRenamed({"_key": "k", "_c": "c"}), "k", "c", F.col("step"), n_states, start, chunk).select(F.col("k").alias("_k"), F.col("c").alias("_b"), F.col("state").alias("first"))
        lists = lists.join(begun, lists["_key"].eqNullSafe(begun["_k"]) & (lists["_c"] == begun["_b"])).select("_key", "_c", "steps", "first")
    else:
        lists = lists.withColumn("first", F.lit(start))
    run = F.aggregate("steps", F.struct(F.col("first").alias("now"), F.expr("CAST(array() AS array<int>)").alias("seen")), lambda a, s: F.struct(F.get(s["step"], a["now"]).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen")))["seen"]
    told = lists.select("_key", F.explode(F.arrays_zip(F.transform("steps", lambda s: s["place"]).alias("place"), run.alias("state"))).alias("x")).select("_key", F.col("x.place").alias("_place"), F.col("x.state").alias("state"))
    return rows.join(told, rows[key].eqNullSafe(told["_key"]) & (rows[at] == told["_place"])).drop("_key", "_place")
