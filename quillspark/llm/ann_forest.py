"""Approximate nearest neighbours by inner product: a forest of hash prefixes.

Every vector gets, for each tree, a string of 64 bits: the sides of random hyperplanes on which it lies (after one more
component has made all norms equal, so that the largest inner product is the smallest angle). The rows of a tree that share
their first bits form a block, a sorted array of hash strings in one group; blocks that are too large are dealt out to
several groups.

A query descends each tree to its longest prefix match; one pass counts, in all trees, the rows that share each number of
bits with it. It then ascends all trees together: the most bits are taken at which the trees hold enough candidates. A
second pass sends the query to the blocks below that prefix, where candidates are scored on the original vectors in double
precision, and only the nearest of each block travel on. Blocks with many rows or many queries are dealt out to several
groups by both.

How many candidates are enough is measured: a bounded sample of the queries is compared with all rows, and the smallest
number is taken at which the trees hold RECALL of their true neighbours. Vectors in clusters need few; vectors spread evenly
over the sphere need nearly all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TREES = 16
BITS = 64
#: Recall that the sampled queries must reach; above the 0.9 that is asked for, as a sample errs.
RECALL = 0.95
#: Queries that are compared with all rows to find how many candidates they need.
TRIED = 256
#: Rows and queries of a group on average at most, and bits of the directory of blocks at most.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
DIRECTORY_BITS = 14
#: Rows on which the planes' offsets are fitted.
SAMPLE = 4096


@dataclass
class Planes:
    normals: np.ndarray  # tree, bit, component
    offsets: np.ndarray  # tree, bit
    top: float  # the largest squared norm

    def hashes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """By row and tree, the hash string as a number, first bit first."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - (x * x).sum(axis=1)))
        full = np.column_stack([x, extra])
        out = np.empty((len(x), len(self.normals)), np.uint64)
        for t, (normal, offset) in enumerate(zip(self.normals, self.offsets)):
            side = full @ normal.T > offset
            out[:, t] = np.packbits(side, axis=1).view(">u8").ravel()
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows with an id and a vector of finite components that aren't all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(finite & F.exists(v, lambda x: x != 0))


def prefix(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def counts_by_level(h: np.ndarray, q: np.ndarray, levels: range) -> np.ndarray:
    """By query hash and level, how many of the hashes share that many first bits with it."""
    h, out = np.sort(h), np.zeros((len(q), len(levels)), np.int64)
    for i, level in enumerate(levels):
        rest = np.uint64((1 << (BITS - level)) - 1)
        out[:, i] = np.searchsorted(h, q | rest, side="right") - np.searchsorted(h, q & ~rest, side="left")
    return out


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits two hash strings share."""
    x, n = a ^ b, np.full(np.broadcast(a, b).shape, BITS)
    for level in range(BITS):
        n = np.where((n == BITS) & ((x >> np.uint64(BITS - 1 - level)) & np.uint64(1) == 1), level, n)
    return n


def enough(entries: DataFrame, queries: DataFrame, planes, dim: int, n: int, k: int, recall: float, tried: int = TRIED) -> int:
    """The smallest number of candidates (the trees' together) with which `tried` of the queries find this share of their k
    true neighbours, which one pass over all rows finds."""
    some = queries.orderBy(F.xxhash64("query"), "query").select("v").limit(tried).collect()
    x = np.array([r["v"] for r in some], np.float64).reshape(-1, dim)
    trees = len(planes.value.normals)
    shared = entries.sparkSession.sparkContext.broadcast((x, planes.value.hashes(x, query=True)))

    def compare(batches):
        own, asked = shared.value
        counts = np.zeros((len(own), BITS + 1), np.int64)
        for batch in batches:
            held = matrix(batch.column("v"), dim)
            if not len(held):
                continue
            h, entry = planes.value.hashes(held, query=False), batch.column("entry").to_numpy()
            for t in range(trees):
                counts += counts_by_level(h[:, t], asked[:, t], range(BITS + 1))
            scores = own @ held.T
            best = np.argpartition(-scores, min(k, len(held) - 1), axis=1)[:, : k + 1]
            levels = shared_bits(h[best], asked[:, None, :])
            rows = np.repeat(np.arange(len(own)), best.shape[1])
            yield pa.record_batch({"q": pa.array(rows, pa.int32()), "entry": pa.array(entry[best].ravel()), "score": pa.array(np.take_along_axis(scores, best, 1).ravel()), "most": pa.array(levels.max(axis=2).ravel(), pa.int32()), "other": pa.array((held[best] != own[:, None, :]).any(axis=2).ravel()), "counts": pa.nulls(len(rows), pa.list_(pa.int64()))})
        yield pa.record_batch({"q": pa.array(np.arange(len(own)), pa.int32()), "entry": pa.nulls(len(own), pa.int64()), "score": pa.nulls(len(own), pa.float64()), "most": pa.nulls(len(own), pa.int32()), "other": pa.nulls(len(own), pa.bool_()), "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    seen = written(entries.select("entry", "v").mapInArrow(compare, "q int, entry bigint, score double, most int, other boolean, counts array<bigint>"), "tried")
    true = seen.filter("other").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "entry"))).filter(F.col("n") <= k)
    found = true.groupBy("q").agg(F.collect_list("most").alias("most")).collect()
    held = {r["q"]: np.array(r["held"]) for r in seen.filter("counts IS NOT NULL").groupBy("q").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS + 1)]).alias("held")).collect()}
    for half in range(2 * BITS, -1, -1):
        target = math.ceil(trees * n * 2 ** (-half / 2))
        shares = [np.mean(np.array(r["most"]) >= int(np.flatnonzero(held[r["q"]] >= target).max(initial=0))) for r in found]
        if not shares or np.mean(shares) >= recall:
            return target
    return trees * n


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, recall: float = RECALL, share: float | None = None, least: int = 0, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), the id of the candidate, score: for each row for which the condition is_query holds, the k
    rows with the largest inner product among those that the forest gives (all others, if they are fewer than k), nearest
    first, ties to the smaller id. The query's own id isn't a candidate. The trees must hold as many rows together as a sample
    of the queries needs for this recall (or this share of all rows, where one is given), and `least` rows.

    Null vectors, zero vectors and those with null or non-finite components take no part, nor do rows with a null id or
    with another number of components than most vectors have (of equally common ones, the smallest). Equal vectors are one
    entry of the forest with their smallest ids, so that copies crowd no block. Of repeated rows with one id and vector one
    counts; rows with one id and different vectors all count. Empty tables give an empty result. Other columns are
    ignored, so that names cannot clash.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    result = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    flagged = vectors.withColumn("is_query", is_query) if not isinstance(is_query, str) else vectors.withColumn("is_query", F.expr(is_query))
    clean = usable(flagged, id_col, vector_col)
    common = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], result)
    dim = common["dim"]
    clean = clean.filter(F.size("v") == dim).distinct()
    queries = usable(flagged.filter("is_query"), id_col, vector_col).filter(F.size("v") == dim).distinct().select(F.col("id").alias("query"), "v")
    queries = written(queries, "queries")

    # equal vectors: the k + 1 smallest ids are enough
    order = Window.partitionBy("v").orderBy("id")
    entries = clean.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(entries.select(F.col("ids")[0].alias("entry"), "ids", "v"), "vectors")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).first()
    n = facts["n"]
    sample = entries.orderBy(F.xxhash64("entry")).select("v").limit(SAMPLE).collect()
    rnd = np.random.default_rng(seed)
    normals = rnd.standard_normal((trees, BITS, dim + 1))
    planes = Planes(normals, np.zeros((trees, BITS)), float(facts["top"]) * (1 + 1e-12))
    x = np.array([r["v"] for r in sample], np.float64)
    center = np.column_stack([x, np.sqrt(np.maximum(0.0, planes.top - (x * x).sum(axis=1)))]).mean(axis=0)
    planes.offsets = normals @ center
    bits = min(DIRECTORY_BITS, max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS)))))
    shared = spark.sparkContext.broadcast(planes)

    def hashed(batches):
        for batch in batches:
            h = shared.value.hashes(matrix(batch.column("v"), dim), query=False)
            for t in range(trees):
                yield pa.record_batch({"tree": pa.array([t] * len(h), pa.int32()), "block": pa.array(prefix(h[:, t], bits)), "entry": batch.column("entry"), "hash": pa.array(h[:, t].view(np.int64)), "v": batch.column("v")})

    vkind = dict(entries.dtypes)["v"]
    forest = written(entries.select("entry", "v").mapInArrow(hashed, f"tree int, block bigint, entry bigint, hash bigint, v {vkind}"), "forest")
    directory = np.zeros((trees, 1 << bits), np.int64)
    for r in forest.groupBy("tree", "block").count().collect():  # trees x 2^bits numbers at most
        directory[r["tree"], r["block"]] = r["count"]
    groups = np.maximum(1, -(-directory // BLOCK_ROWS))
    wanted = enough(entries, queries, shared, dim, n, k, recall) if share is None else math.ceil(share * n)
    target = max(least, trees * (2 * k + 2), wanted)
    levels = spark.sparkContext.broadcast((directory, groups))

    sized = spark.createDataFrame([(int(t), int(b), int(groups[t, b])) for t, b in zip(*np.nonzero(groups > 1))], "tree int, block bigint, parts int") if (groups > 1).any() else None
    if sized is not None:
        forest = forest.join(F.broadcast(sized), ["tree", "block"], "left").withColumn("part", F.pmod(F.xxhash64("entry"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        forest = forest.withColumn("part", F.lit(0))

    def own_blocks(batches):
        """A row for each tree and part of the query's own block."""
        for batch in batches:
            h = shared.value.hashes(matrix(batch.column("v"), dim), query=True)
            out = {"tree": [], "block": [], "part": [], "query": [], "hash": []}
            for q, row in zip(batch.column("query").to_pylist(), h):
                for t in range(trees):
                    block = int(prefix(row[t : t + 1], bits)[0])
                    for part in range(levels.value[1][t, block]):
                        for name, value in zip(out, (t, block, part, q, int(row[t : t + 1].view(np.int64)[0]))):
                            out[name].append(value)
            yield pa.record_batch({c: pa.array(v, pa.int32() if c in ("tree", "part") else pa.int64()) for c, v in out.items()})

    def count_deep(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """Rows that share bits + 1 .. 64 bits with each query."""
        h = rows["hash"].to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
        q = asked["hash"].to_numpy().view(np.uint64) if asked.num_rows else np.zeros(0, np.uint64)
        counts = counts_by_level(h, q, range(bits + 1, BITS + 1))
        return pa.table({"query": asked["query"], "counts": pa.array(list(counts), pa.list_(pa.int64()))})

    keys = ["tree", "block", "part", "chunk"]

    def dealt(rows: DataFrame, asked: DataFrame):
        """Rows of blocks and the queries sent to them in groups of bounded size, as both are dealt out: the rows once for
        each chunk of the block's queries. Counts of queries are trees x 2^bits numbers at most."""
        many = asked.groupBy("tree", "block", "part").count().filter(F.col("count") > BLOCK_QUERIES).select("tree", "block", F.ceil(F.col("count") / BLOCK_QUERIES).cast("int").alias("chunks")).groupBy("tree", "block").agg(F.max("chunks").alias("chunks")).collect()
        if not many:
            return rows.withColumn("chunk", F.lit(0)), asked.withColumn("chunk", F.lit(0))
        chunks = F.broadcast(spark.createDataFrame(many, "tree int, block bigint, chunks int"))
        n = F.coalesce("chunks", F.lit(1))
        spread = rows.join(chunks, ["tree", "block"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).drop("chunks")
        return spread, asked.join(chunks, ["tree", "block"], "left").withColumn("chunk", F.pmod(F.xxhash64("query"), n).cast("int")).drop("chunks")

    near = written(queries.mapInArrow(own_blocks, "tree int, block bigint, part int, query bigint, hash bigint"), "own-blocks")
    rows, own = dealt(forest.select("tree", "block", "part", "hash"), near)
    deep = rows.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(count_deep, "query bigint, counts array<bigint>")
    totals = deep.groupBy("query").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS - bits)]).alias("deep"))

    def ascend(batches):
        """The level of each query, and a row for each tree, block and part under its prefix."""
        directory, groups = levels.value
        # rows under each prefix of 0 .. bits bits
        above = [directory.reshape(trees, 1 << level, -1).sum(axis=2) for level in range(bits + 1)]
        for batch in batches:
            h = shared.value.hashes(matrix(batch.column("v"), dim), query=True)
            out = {"tree": [], "block": [], "part": [], "query": [], "hash": [], "level": []}
            for q, deep, row in zip(batch.column("query").to_pylist(), batch.column("deep").to_pylist(), h):
                shallow = [sum(int(above[level][t, int(prefix(row[t : t + 1], level)[0])]) for t in range(trees)) for level in range(bits + 1)]
                level = max((lv for lv, held in enumerate([*shallow, *(deep or [])]) if held >= target), default=0)
                for t in range(trees):
                    span = 1 << max(0, bits - level)
                    first = int(prefix(row[t : t + 1], min(level, bits))[0]) * span
                    for block in range(first, first + span):
                        if directory[t, block]:
                            for part in range(groups[t, block]):
                                for name, value in zip(out, (t, block, part, q, int(row[t : t + 1].view(np.int64)[0]), level)):
                                    out[name].append(value)
            yield pa.record_batch({c: pa.array(v, pa.int32() if c in ("tree", "part", "level") else pa.int64()) for c, v in out.items()})

    sent = written(queries.join(totals, "query", "left").select("query", "v", "deep").mapInArrow(ascend, "tree int, block bigint, part int, query bigint, hash bigint, level int"), "sent")
    rows, sent = dealt(forest.select("tree", "block", "part", "entry", "hash", "v"), sent)
    asked = sent.join(queries, "query")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        queries_, entries_, scores_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            h = rows["hash"].to_numpy().view(np.uint64)
            sort = np.argsort(h)
            h, ids = h[sort], rows["entry"].to_numpy()[sort]
            held = matrix(rows["v"].combine_chunks(), dim)[sort]
            q, level = asked["hash"].to_numpy().view(np.uint64), asked["level"].to_numpy()
            query, own = asked["query"].to_numpy(), matrix(asked["v"].combine_chunks(), dim)
            rest = np.where(level > bits, np.array([(1 << (BITS - lv)) - 1 for lv in level.tolist()], np.uint64), np.uint64((1 << BITS) - 1))
            lo, hi = np.searchsorted(h, q & ~rest, side="left"), np.searchsorted(h, q | rest, side="right")
            for at in range(0, len(q), 128):
                found = own[at : at + 128] @ held.T
                for i in range(len(found)):
                    a, b = lo[at + i], hi[at + i]
                    s = found[i, a:b]
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k + 1 else np.arange(len(s))
                    best = some[np.lexsort((ids[a:b][some], -s[some]))][: k + 1]
                    queries_.append(np.full(len(best), query[at + i]))
                    entries_.append(ids[a:b][best])
                    scores_.append(s[best])
        return pa.table({"query": np.concatenate(queries_), "entry": np.concatenate(entries_), "score": np.concatenate(scores_)})

    nearest = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(score, "query bigint, entry bigint, score double")
    best = nearest.groupBy("query", "entry").agg(F.max("score").alias("score"))
    top = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).filter(F.col("n") <= k + 1)
    each = top.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("id")).filter(F.col("id") != F.col("query"))
    ranked = each.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(id_col), "score")
