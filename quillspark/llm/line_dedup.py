"""Line dedup with two Bloom filters for each range of hashes.

A first pass over the texts writes a digest of every line key, without the text. The digests' hashes, one of a kind from each
batch, are dealt out by range; in each range a filter of those seen once and one of those seen again, sized by the range's
keys, tell which are suspected to be repeated. Only digests of suspects are shuffled, to count the documents that hold them
and to choose the occurrence that stays (a false positive of a filter costs a shuffled digest, never a wrong result). Keys
that many lines have are joined by broadcast, of which there can't be many. Documents that lose lines are marked in a filter
of ids; only they are shuffled to meet what they lose, all others are done where they are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts, unused, written

#: Bytes of text whose lines are digested at once.
AT_ONCE = 1 << 20
#: Keys of a range of hashes, whose two filters are in one task.
RANGE_KEYS = 1 << 21
#: Bits of a filter for each key or id.
KEY_BITS, ID_BITS = 8, 16
#: Bits of the filter of ids at most (64 MB), in segments that are merged apart from each other. Beyond some 30 million
#: documents that lose lines, more and more others are shuffled for nothing.
FILTER_BITS = 1 << 29
SEGMENTS = 32
HASHES = 4
#: Partial filters that one merge takes.
FAN_IN = 64
#: A key that more than this part of all rows have is hot; there are so many hot keys at most.
HOT_KEYS = 10_000
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, shortest: int) -> bytes:
    """A line's key, empty if it is shorter than `shortest` code points."""
    key = line.strip(_STRIP).lower()
    return key if len(key) >= shortest and (key.isascii() or len(key.decode()) >= shortest) else b""


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key."""
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bits of each hash in the filter, by hash function."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(8 * len(bits)) for i in range(HASHES)])


def add(bits: np.ndarray, hashes: np.ndarray) -> None:
    at = positions(bits, hashes).ravel()
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = positions(bits, hashes)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).all(axis=0)


def room(keys: int, each: int) -> int:
    """Bytes of a filter for so many keys."""
    return min(FILTER_BITS, max(1 << 13, 1 << (each * max(1, keys) - 1).bit_length())) // 8


def suspects(digests: DataFrame, total: int) -> DataFrame:
    """h, n: the hashes that were seen again, and perhaps a few others, with their rows. digests: rows with h, `total` in all."""
    spark = digests.sparkSession
    parts = max(math.ceil(total / RANGE_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = room(2 * total // parts + 1, KEY_BITS)

    def distinct(batches):
        for batch in batches:
            found, n = np.unique(batch.column("h").to_numpy(), return_counts=True)
            yield pa.record_batch({"h": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    def again(batches):
        once, twice, held = np.zeros(size, np.uint8), np.zeros(size, np.uint8), []
        for batch in batches:
            h, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "n"))
            found, at, seen = np.unique(h.view(np.uint64), return_inverse=True, return_counts=True)
            add(twice, found[(seen > 1) | (np.bincount(at, n) > 1) | holds(once, found)])
            add(once, found)
            held.append((h, n))
        for h, n in held:
            some = holds(twice, h.view(np.uint64))
            yield pa.record_batch({"h": pa.array(h[some], pa.int64()), "n": pa.array(n[some], pa.int64())})

    schema = "h bigint, n bigint"
    met = digests.select("h").mapInArrow(distinct, schema).repartition(parts, "h").mapInArrow(again, schema)
    return met.groupBy("h").agg(F.sum("n").alias("n"))


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with the keys of `keyed` (with n, how many rows have the key), of `total` rows in all: hot keys by
    broadcast, so that none is a task of its own."""
    share = max(1, total // HOT_KEYS)
    hot = F.broadcast(keyed.filter(F.col("n") > share).drop("n"))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(keyed.filter(F.col("n") <= share).drop("n"), keys)
    return rows.join(hot, keys).unionByName(cold)


def id_filter(hashes: DataFrame, total: int) -> np.ndarray:
    """A filter of the hashes (h), merged in a tree of groups by segments."""
    size = room(total, ID_BITS)
    segments = min(SEGMENTS, size // 32)
    step = size // segments

    def fill(batches):
        own = np.zeros(size, np.uint8)
        for batch in batches:
            add(own, batch.column("h").to_numpy().view(np.uint64))
        pack, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()
        for s in range(segments):
            if (cut := own[s * step : (s + 1) * step]).any():
                yield pa.record_batch({"segment": pa.array([s], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([pack(cut.tobytes())])})

    def merge(table: pa.Table) -> pa.Table:
        read, whole = zstandard.ZstdDecompressor().decompress, np.zeros(step, np.uint8)
        for bits in table["bits"]:
            whole |= np.frombuffer(read(bits.as_py()), np.uint8)
        return pa.table({"segment": table["segment"][:1], "part": table["part"][:1], "bits": pa.array([zstandard.ZstdCompressor(level=1).compress(whole.tobytes())])})

    schema = "segment int, part int, bits binary"
    parts = written(hashes.select("h").mapInArrow(fill, schema), "id-filters")
    left = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    while left > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("segment", "part").applyInArrow(merge, schema)
        left = -(-left // FAN_IN)
    whole = np.zeros(size, np.uint8)
    for row in parts.select("segment", "bits").toLocalIterator():
        whole[row["segment"] * step : (row["segment"] + 1) * step] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["bits"])), np.uint8)
    return whole


def lost_lines(docs: DataFrame, id_col: str, text_col: str, shortest: int, least_docs: int) -> DataFrame:
    """id, lost: for each id that loses lines the digests of their keys, as binaries."""
    kind = dict(docs.dtypes)[id_col]

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = [], []
        for i, (t, some) in enumerate(zip(texts(batch, text_col), batch.column("id").is_valid().to_pylist())):
            own = {line_key(line, shortest) for line in (t or b"").split(b"\n")} - {b""} if some else ()
            rows += [i] * len(own)
            keys += own
        halves = np.frombuffer(b"".join(map(digest, keys)), np.int64).reshape(-1, 2)
        return pa.record_batch({"id": batch.column("id").take(pa.array(rows, pa.int64())), "h": pa.array(np.ascontiguousarray(halves[:, 0]), pa.int64()), "k": pa.array(np.ascontiguousarray(halves[:, 1]), pa.int64())})

    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias(text_col))
    held = written(map_slices(named, text_col, lines, f"id {kind}, h bigint, k bigint", AT_ONCE), "line-digests")
    total = held.count()
    again = written(suspects(held, total), "suspects")
    some = written(joined(held, again, ["h"], total), "suspected-lines")
    # by key the ids that hold it, each once, and the largest
    counted = some.groupBy("h", "k").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("last"), F.count("*").alias("n"))
    confirmed = written(counted.filter(F.col("docs") >= least_docs).select("h", "k", "last", "n"), "repeats")
    gone = joined(some, confirmed, ["h", "k"], total).filter(F.col("id") < F.col("last"))
    return written(gone.groupBy("id").agg(F.collect_set(F.struct("h", "k")).alias("lost")), "lost-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 40, least_docs: int = 5, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_lines (before dropping), n_dropped, kept (the text that is left), and the columns in
    keep.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys are told apart by 128-bit digests. Keys of
    at least `shortest` code points that at least `least_docs` ids hold lose all their lines but those in the largest such id.
    A null or empty text is one empty line, and stays null or empty. Rows with a null id are returned as they are; their lines
    aren't counted. Repeated rows count as one document and each lose the same lines. An empty table gives an empty result.
    Columns outside keep are dropped, and those in keep named as the results are replaced by them. Texts are split whole,
    whatever their length.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    kept = [id_col, *(c for c in keep or [] if c not in (id_col, "n_lines", "n_dropped", "kept"))]
    columns = list(dict.fromkeys([*kept, text_col]))
    lost = lost_lines(docs, id_col, text_col, shortest, least_docs)
    marked = spark.sparkContext.broadcast(id_filter(lost.select(F.xxhash64("id").alias("h")), lost.count()))
    own_id, lost_keys, own_hash = unused("lost_id", columns), unused("lost_keys", columns), unused("id_hash", columns)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + "n_lines bigint, n_dropped bigint, kept string"

    def told(batch: pa.RecordBatch, lost: list) -> pa.RecordBatch:
        n, dropped, left = [], [], []
        for text, gone in zip(texts(batch, text_col), lost):
            own = (text or b"").split(b"\n")
            keys = {(x["h"], x["k"]) for x in gone or ()}
            stay = [line for line in own if not (key := line_key(line, shortest)) or tuple(np.frombuffer(digest(key), np.int64).tolist()) not in keys] if keys else own
            n.append(len(own))
            dropped.append(len(own) - len(stay))
            left.append(None if text is None else b"\n".join(stay).decode())
        return pa.record_batch({c: batch.column(c) for c in kept} | {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(left, pa.string())})

    def is_marked(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(id_col).is_valid().to_numpy(zero_copy_only=False) & holds(marked.value, batch.column(own_hash).to_numpy().view(np.uint64))

    def clear(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents that lose nothing."""
        batch = batch.filter(pa.array(~is_marked(batch)))
        return told(batch, [None] * batch.num_rows)

    def unclear(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(is_marked(batch))).select(columns)

    hashed = docs.select(*columns, F.xxhash64(docs[id_col]).alias(own_hash))
    some = map_slices(hashed, text_col, unclear, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    # by a shuffle of both at any size
    lost = lost.select(F.col("id").alias(own_id), F.col("lost").alias(lost_keys)).hint("merge")
    met = some.join(lost, some[id_col] == lost[own_id], "left").select(*columns, lost_keys)
    return map_slices(hashed, text_col, clear, schema).union(map_slices(met, text_col, lambda batch: told(batch, batch.column(lost_keys).to_pylist()), schema))
