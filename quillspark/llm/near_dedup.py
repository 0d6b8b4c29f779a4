"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text's set of shingles is hashed; its sketch is the SKETCH smallest hashes. Texts with equal sets form a class, which
   the smallest id represents.
2. Inverted lists of retained values generate candidates. Two sets as similar as asked share at least T of the values that
   their union retains (but for a probability of MISSED), so that of each sketch only the rarest values, all but T - 1, are
   listed: similar sets meet in one of these lists, and passages that many texts share don't make long lists.
3. In each list, every class is paired with the list's first one; the pair's union sketch (the smallest hashes of both) must
   hold T shared values. Pairs that pass are verified on the full sets, and linked classes get a common component.
4. Lists whose classes are now in several components are finished exactly: the classes outside the list's largest component
   meet all others of similar sizes block by block. A class's text comes to a block once; there, full sets are compared
   with those of other components, linked components become one at once, and only the links that joined two leave the block.

Long lists are never gathered in one task, and no row stands for a pair of a group but the links of a spanning forest.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, map_slices, texts, written
from .words import mix, words

SKETCH = 64
#: Probability that two sets of just the similarity asked for share no list, or too few values of their union sketch.
MISSED = 1e-6
#: Classes on either side of a block at most, and their shingles.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@cache
def least_shared(threshold: float, sketch: int) -> int:
    """T: two sets of this similarity share fewer of the `sketch` smallest values of their union with probability MISSED at
    most, as each of these is in both with the similarity as probability."""
    below, t = 0.0, 0
    while True:
        below += math.comb(sketch, t) * threshold**t * (1 - threshold) ** (sketch - t)
        if below > MISSED:
            return max(1, t)
        t += 1


def shingle_sets(batch: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. With fewer words than size, the whole sequence is the one shingle."""
    found = words(batch, lower=True)
    n = max(0, len(found.hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _A + found.hashes[i : i + n] + np.uint64(i)
    total = mix(total)
    out = []
    for lo, hi in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(total[lo : hi - size + 1]))
        elif hi > lo:
            short = np.array([(hi - lo) * 0x165667B1], np.uint64)
            for h in found.hashes[lo:hi]:
                short = short * _B + h
            out.append(mix(short * _C))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def plausible(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold: float, sketch: int | None) -> bool:
    """Whether two sets with these sketches and sizes may be similar: exactly, where the sketches hold all of both sets."""
    if min(n_a, n_b) < threshold * max(n_a, n_b):
        return False
    shared, union = np.intersect1d(a, b, assume_unique=True), np.union1d(a, b)
    if sketch is None or max(n_a, n_b) <= sketch:
        return len(shared) >= threshold * len(union) - 1e-9
    # the smallest values of the union that both sketches retain
    return int(np.searchsorted(shared, union[min(sketch, len(union)) - 1], side="right")) >= least_shared(threshold, sketch)


def components(links: DataFrame) -> DataFrame:
    """id, component of every node of the edges (a, b): the smallest id reachable. Large-star and small-star steps shorten
    the paths, each step's edges are written, and the loop ends when a step changes nothing."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = written(small, "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", F.col("b")).distinct())
        before = after


def similar(both, n_a, n_b, threshold: float):
    """Whether sets of these sizes that share `both` values are as similar as asked."""
    return round(threshold * 1e6) * (n_a + n_b - both) <= both * 10**6


def block_links(members: list[dict], shingle: int, threshold: float) -> list[tuple[int, int]]:
    """Links between classes that ask and others, as many as it takes to join the components that are linked in the block."""
    read = zstandard.ZstdDecompressor().decompress
    members = sorted(members, key=lambda m: (m["asks"], m["class_id"]))
    ids, component = (np.array([m[c] for m in members]) for c in ("class_id", "component"))
    first = sum(not m["asks"] for m in members)
    if not 0 < first < len(members):
        return []
    sets = shingle_sets([read(m["z"]) for m in members], shingle)
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(values), bool)
    out = []
    for p in range(first, len(members)):
        if (component[:first] == component[p]).all():
            continue
        own = codes[starts[p] : starts[p + 1]]
        held[own] = True
        both = np.add.reduceat(held[codes[: starts[first]]], starts[:first], dtype=np.int64)
        held[own] = False
        for q in np.flatnonzero(similar(both, sizes[p], sizes[:first], threshold)).tolist():
            if component[p] != component[q]:
                component[component == component[p]] = component[q]
                out.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, sketch: int | None = SKETCH) -> DataFrame:
    """One row per distinct id of docs: id, n_shingles, class_id (the smallest id with the same shingles), n_links (links of
    this id's class that were confirmed; those that join nothing new aren't looked for), component_id (the smallest id
    reachable over links), kept (id = component_id).

    Words are `[^\\x20\\x09-\\x0D]+` of the text, A-Z lower-cased; a set holds the distinct runs of `shingle` words, or with
    fewer words the whole sequence. Sets with a Jaccard similarity of at least `threshold` are linked. A link of just the
    threshold is missed with a probability of MISSED; with sketch=None whole sets take the place of sketches, which costs
    longer lists, and no link can be missed. A null text, or one without words, has no shingles and is linked with nothing.
    Of several rows with one id, the largest text counts. Rows with a null id take no part and aren't returned. An empty
    table gives an empty result. Other columns are dropped, so that names cannot clash. ids must be integers.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch, "text"), shingle)
        return pa.record_batch({"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int32()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "sketch": pa.array([s[:sketch].view(np.int64) for s in sets], pa.list_(pa.int64()))})

    rows = written(map_slices(plain, "text", sketches, "id bigint, n int, digest binary, sketch array<bigint>"), "sketches")
    # one row an id, by the largest digest if its rows differ
    ids = written(rows.groupBy("id").agg(F.max(F.struct("n", "digest")).alias("s")).select("id", "s.n", "s.digest"), "ids")
    class_ids = ids.filter("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"))
    sketched = rows.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(sketched.join(class_ids, "digest").select("class_id", "n", "sketch"), "classes")

    # the rarest values of each class that other classes have too
    held = classes.select("class_id", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = held.join(common, "value").groupBy("class_id").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    # a set this small is a sketch in full, and so are all that are similar to it
    whole = F.lit(True) if sketch is None else F.col("k") < int(threshold * sketch)
    least = F.when(whole, F.ceil(F.col("k") * F.lit(threshold) - 1e-9)).otherwise(F.lit(1 if sketch is None else least_shared(threshold, sketch))).cast("int")
    # the values that no other class has are the rarest and come first; they have no lists
    prefix = F.greatest(F.lit(0), F.col("k") - F.greatest(F.lit(1), least) + 1 - (F.col("k") - F.size("v")))
    lists = written(ordered.select("class_id", F.explode(F.slice("v", F.lit(1), prefix.cast("int"))).alias("v")).select("class_id", F.col("v.value").alias("value")), "lists")

    def packed(wanted: DataFrame, name: str) -> DataFrame:
        """Texts of the ids, compressed, which are smaller than their sets: id, z."""
        wanted = written(wanted.distinct(), f"{name}-ids")
        met = among(plain, "id", wanted).join(wanted, "id")

        def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, compress = texts(batch, "text"), zstandard.ZstdCompressor(level=3).compress
            sets = shingle_sets(found, shingle)
            return pa.record_batch({"id": batch.column("id"), "n": pa.array([len(s) for s in sets], pa.int32()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "z": pa.array([compress(t or b"") for t in found], pa.binary())})

        return written(map_slices(met, "text", pack, "id bigint, n int, digest binary, z binary").groupBy("id").agg(F.max_by("z", F.struct("n", "digest")).alias("z")), name)

    small = classes.select("class_id", "n", "sketch")
    firsts = lists.groupBy("value").agg(F.min("class_id").alias("a"))
    stars = lists.join(firsts, "value").filter("class_id <> a").select("a", F.col("class_id").alias("b")).distinct()
    met = stars.join(small.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a").join(small.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")

    def likely(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b")]
            good = [plausible(np.array(p, np.int64).view(np.uint64), np.array(q, np.int64).view(np.uint64), m, n, threshold, sketch) for p, q, m, n in zip(*columns)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(good, pa.bool_()))

    def verify(batches):
        read = zstandard.ZstdDecompressor().decompress
        last, held = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a != last:
                    last, held = a, shingle_sets([read(x.as_py())], shingle)[0]
                other = shingle_sets([read(y.as_py())], shingle)[0]
                good.append(similar(len(np.intersect1d(held, other, assume_unique=True)), len(held), len(other), threshold))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(good, pa.bool_()))

    pairs = written(met.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(likely, "a bigint, b bigint"), "stars")
    z = packed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "star-texts")
    compared = pairs.join(z.select(F.col("id").alias("b"), F.col("z").alias("y")), "b").join(z.select(F.col("id").alias("a"), F.col("z").alias("x")), "a")
    links = written(compared.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"), "links")
    found = components(links)

    # lists that several components still meet in: a pair of them has a class outside the list's largest component
    labelled = lists.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("value", "class_id", F.coalesce("component", "class_id").alias("component"))
    sign = lambda *x: F.bit_xor(F.xxhash64(*x))
    held_by = labelled.groupBy("value", "component").agg(F.count("*").alias("members"), sign("class_id").alias("s"), sign("class_id", F.lit(1)).alias("t"))
    mixed = held_by.groupBy("value").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("members").alias("size"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"))
    # a list of two was compared in full, longer ones only against their first class; of lists with the same classes one is enough
    still = mixed.filter("parts > 1 and size > 2").groupBy("size", "s", "t").agg(F.min(F.struct("value", "largest")).alias("v")).select("v.value", "v.largest")
    open_lists = labelled.join(still, "value")
    # similar sets are of the same range of sizes or of the next one
    sized = open_lists.join(classes.select("class_id", "n"), "class_id").withColumn("range", F.floor(F.log("n") / -math.log(threshold)).cast("int")).drop("n")
    sized = written(sized.withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), "open-lists")
    if not sized.isEmpty():
        keys = ["value", "range"]
        outside = sized.filter("outside").select("value", "class_id", "component", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range"))
        side = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES * F.pow(F.lit(threshold), F.col("range") + 1))))
        dealt = lambda frame, name: frame.groupBy(*keys).agg(F.count("*").alias("c")).select(*keys, F.ceil(F.col("c") / side).cast("int").alias(name))
        counts = dealt(outside, "chunks").join(dealt(sized, "blocks"), keys)
        of = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        insiders = sized.join(counts, keys).select(*keys, "class_id", "component", of("blocks").alias("block"), each("chunks").alias("chunk"), F.lit(False).alias("asks"))
        askers = outside.join(counts, keys).select(*keys, "class_id", "component", each("blocks").alias("block"), of("chunks").alias("chunk"), F.lit(True).alias("asks"))
        # blocks are small but take long: parts by their number, not by bytes
        blocks = counts.agg(F.sum(F.col("chunks") * F.col("blocks"))).first()[0]
        parts = int(min(blocks, max(blocks // 16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        whole_texts = packed(sized.select(F.col("class_id").alias("id")), "open-texts").withColumnRenamed("id", "class_id")
        meeting = insiders.union(askers).join(whole_texts, "class_id").repartition(parts, *keys, "block", "chunk").groupBy(*keys, "block", "chunk").agg(F.collect_list(F.struct("class_id", "component", "asks", "z")).alias("members"))

        def across(batches):
            for batch in batches:
                for members in batch.column("members"):
                    pairs = block_links(members.as_py(), shingle, threshold)
                    yield pa.record_batch({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        more = written(meeting.select("members").mapInArrow(across, "a bigint, b bigint").distinct(), "more-links")
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)

    counted = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"))
    told = ids.join(class_ids, "digest", "left").join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left").join(counted, "class_id", "left")
    component = F.coalesce("component", "class_id", "id")
    return told.select(F.col("id").cast(kind).alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("class_id", "id").cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.cast(kind).alias("component_id"), (F.col("id") == component).alias("kept"))
