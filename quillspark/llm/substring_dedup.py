"""Substring dedup by relative Lempel-Ziv parsing.

Documents are dealt into groups by a hash of their id. Each group is a reference block; its index is the sorted array of
fingerprints of all runs of `least` words (seeds), each with the smallest id that holds it in the block and the place where
it stands there. The index entries of all blocks meet in buckets of the fingerprint space, so that every document is looked
up in every block without comparing blocks pairwise: a bucket answers each block with the seeds that an earlier document of
some block holds, and with that document and place. A block then parses its documents greedily: a factor starts at the first
seed with an earlier holder and is extended word by word while that holder's text goes on with the same words, that is while
the next seed stands one word further in the same document; at its end, the seeds that straddle the boundary have been
looked up like any other, so that the next factor may start inside the last one. Factors of `least` words or more are
duplicate spans. Of several sources of a seed the smallest id is taken, not the one with the longest match: for what is
removed it makes no difference.

A seed is sent once for each block that holds it, whatever the number of documents; a block and a bucket have bounded sizes.
Two different seeds of different blocks are taken for equal with a probability of 2^-72 (64 bits of a fingerprint and 8 of
the words' lengths and letters); among 10^13 seeds, some 10,000 pairs are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .words import window_checks, windows, words

#: Bytes of text in a block, and seeds in a bucket, on average.
BLOCK_BYTES = 4 << 20
BUCKET_SEEDS = 1_000_000
#: A seed takes this many bytes of text or more.
SEED_BYTES = 4
#: What travels of an index to its buckets, and back.
_LOW = np.uint64(32)
_ENTRY = ["seeds", "checks", "holders", "holder", "places"]
_ANSWER = ["places", "sources", "source", "source_places"]


def _pack(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, so that bytes that are often zero compress."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


@dataclass
class Index:
    seeds: np.ndarray  # sorted, distinct
    checks: np.ndarray
    holders: np.ndarray  # the smallest id that holds each seed, and the word at which it stands there
    places: np.ndarray
    of_window: np.ndarray  # by window, the number of its seed
    at: np.ndarray  # by window, the word at which it starts


def block_index(ids: np.ndarray, found, least: int) -> Index:
    """The texts are in the order of their ids, so that a seed's first window is the earliest. Of several rows with one id,
    places count from each row's first word."""
    seeds, at = windows(found, least)
    distinct, where, number = np.unique(seeds, return_index=True, return_inverse=True)
    first = at[where]
    of = found.text_of()[first] if len(first) else first
    return Index(distinct, window_checks(found, first, least), ids[of], first - found.firsts[of], number, at)


def equal_runs(seeds: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal seeds stand together, and where each run of them starts."""
    order = np.argsort(seeds, kind="stable")
    for sort in (None, lambda: np.lexsort((checks, seeds))):
        order = order if sort is None else sort()
        by = seeds[order]
        same = by[1:] == by[:-1]
        by = checks[order]
        differ = by[1:] != by[:-1]
        if not (same & differ).any():
            break
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(seeds)), bool), ~same | differ]))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 13) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words left, joined by single blanks), spans (array of
    struct<start, length, source, source_start>: the factors that were removed, in words of the input, and the document that
    has the same words, from which of its words on).

    Words are `[^\\x20\\x09-\\x0D]+`. Every word that some run of `least` words covers is removed if the run also starts in
    a document with a smaller id; runs are judged on the input. A null text has no words and an empty kept text. Rows with
    a null id lose nothing and count for nothing. Repeated ids are one document: their rows don't count against each other.
    An empty table gives an empty result; other columns are dropped, so that names cannot clash. ids must be integers.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    buckets = max(1, math.ceil(total / SEED_BYTES / BUCKET_SEEDS))
    kind = dict(docs.dtypes)[id_col]
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col)), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def parsed(table: pa.Table):
        """The rows in the order of their ids, null ones last."""
        table = table.take(pc.sort_indices(table, [("id", "ascending")])).combine_chunks()
        some = table["id"].is_valid().to_numpy(zero_copy_only=False)
        rows = texts(table.to_batches()[0], "text")
        ids = np.where(some, table["id"].fill_null(0).to_numpy(), 0)
        found = words([t if x else None for t, x in zip(rows, some)])
        return table["id"], rows, ids, found

    def bounds(distinct: np.ndarray) -> np.ndarray:
        """Where each bucket starts in the sorted seeds."""
        width = (1 << 64) // buckets + 1
        return np.searchsorted(distinct, np.array([min(b * width, (1 << 64) - 1) for b in range(buckets)], np.uint64)) if buckets > 1 else np.zeros(1, np.int64)

    def index(table: pa.Table) -> pa.Table:
        _, _, ids, found = parsed(table)
        index = block_index(ids, found, least)
        cut = np.append(bounds(index.seeds), len(index.seeds))
        out = {"bucket": [], "block": [], **{c: [] for c in _ENTRY}}
        block = table["block"][0].as_py()
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            known, number = np.unique(index.holders[part], return_inverse=True)
            packed = _steps(index.seeds[part]), index.checks[part], _steps(known), number.astype(np.uint32), index.places[part].astype(np.uint32)
            for name, x in zip(out, (int(b), block, *map(_pack, packed))):
                out[name].append(x)
        return pa.table({c: pa.array(v, pa.binary() if c in _ENTRY else pa.int32()) for c, v in out.items()})

    def answer(table: pa.Table) -> pa.Table:
        read = lambda c, kind: (_unpack(x.as_py(), kind) for x in table[c])
        seeds = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("seeds", np.uint64)])
        known = [np.cumsum(x) for x in read("holders", np.int64)]
        every = np.unique(np.concatenate(known))
        # a holder's number among all, and its place, in one integer
        own = [(np.searchsorted(every, k).astype(np.uint64)[h] << _LOW) | p for k, h, p in zip(known, read("holder", np.uint32), read("places", np.uint32))]
        ends = np.cumsum([len(x) for x in own])
        own = np.concatenate(own)
        order, starts = equal_runs(seeds, np.concatenate(list(read("checks", np.uint8))))
        del seeds
        least_of = np.repeat(np.minimum.reduceat(own[order], starts), np.diff(np.append(starts, len(order))))
        earliest = np.empty(len(order), np.uint64)
        earliest[order] = least_of
        del order, least_of
        out = {"bucket": [], "block": [], **{c: [] for c in _ANSWER}}
        for bucket, block, lo, hi in zip(table["bucket"], table["block"], [0, *ends[:-1]], ends):
            told = np.flatnonzero(earliest[lo:hi] >> _LOW < own[lo:hi] >> _LOW)
            if len(told):
                found = earliest[lo:hi][told]
                sources, number = np.unique(every[(found >> _LOW).astype(np.int64)], return_inverse=True)
                packed = _steps(told), _steps(sources), number.astype(np.uint32), found.astype(np.uint32)
                for name, x in zip(out, (bucket.as_py(), block.as_py(), *map(_pack, packed))):
                    out[name].append(x)
        return pa.table({c: pa.array(v, pa.binary() if c in _ANSWER else pa.int32()) for c, v in out.items()})

    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "source", "source_start")]))

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "spans": pa.array([], span)})
        own_ids, rows, ids, found = parsed(table)
        index = block_index(ids, found, least)
        at, cut = index.at, bounds(index.seeds)
        for bucket, *packed in zip(answers["bucket"], *(answers[c] for c in _ANSWER)):
            told, known, number, places = (_unpack(x.as_py(), kind) for x, kind in zip(packed, (np.int64, np.int64, np.uint32, np.uint32)))
            mine = cut[bucket.as_py()] + np.cumsum(told)
            index.holders[mine], index.places[mine] = np.cumsum(known)[number], places
        of = found.text_of()[at] if len(at) else at
        source, place = index.holders[index.of_window], index.places[index.of_window]
        hits = np.flatnonzero(source < ids[of]) if len(at) else at
        # a factor ends where the next seed has no earlier holder, or doesn't go on there, or starts in another text
        goes_on = lambda x, step: x[hits[1:]] == x[hits[:-1]] + step
        new = np.ones(len(hits), bool)
        new[1:] = ~(goes_on(at, 1) & goes_on(of, 0) & goes_on(source, 0) & goes_on(place, 1))
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(hits)) - 1 if len(hits) else begins
        factors: dict[int, list] = {}
        gone = np.zeros(len(found.hashes) + 1, np.int32)
        for b, e in zip(begins, ends):
            start, stop, text = int(at[hits[b]]), int(at[hits[e]]) + least, int(of[hits[b]])
            gone[start] += 1
            gone[stop] -= 1
            factors.setdefault(text, []).append({"start": start - int(found.firsts[text]), "length": stop - start, "source": int(source[hits[b]]), "source_start": int(place[hits[b]])})
        stays = np.cumsum(gone[:-1]) == 0
        counts, kept, removed, spans = [], [], [], []
        for i, text in enumerate(rows):
            lo, hi = int(found.firsts[i]), int(found.firsts[i + 1])
            own = (text or b"").split()
            counts.append(len(own))
            if i in factors:
                left = [w for w, s in zip(own, stays[lo:hi].tolist()) if s]
                kept.append(b" ".join(left).decode())
                removed.append(len(own) - len(left))
            else:
                kept.append(b" ".join(own).decode())
                removed.append(0)
            spans.append(factors.get(i, []))
        return pa.table({"id": own_ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, span)})

    binary = lambda names: "bucket int, block int, " + ", ".join(f"{c} binary" for c in names)
    entries = dealt.groupBy("block").applyInArrow(index, binary(_ENTRY))
    answers = entries.groupBy("bucket").applyInArrow(answer, binary(_ANSWER))
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(parse, "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, length: bigint, source: bigint, source_start: bigint>>")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept", "spans")
