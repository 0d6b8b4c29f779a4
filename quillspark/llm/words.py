"""Hashes of the words of many texts at once, as numpy operations on their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


#: Bytes that are hashed at once; the tables of powers are as long.
_STEP = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of bytes, which are in order: differences of a running polynomial, made relative to where
    each span starts. A hash doesn't depend on where the span stands."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + _STEP, side="right")))
        part = data[low : int(ends[stop - 1])]
        power, inverse = _to(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=run[1:])
        first, last = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (run[last] - run[first]) * inverse[first] + (last - first).astype(np.uint64)
        at = stop
    return mix(out)


@dataclass
class Words:
    """Words of several texts in order: 64-bit hashes, where each starts and ends in `joined`, and each text's first word
    (with one more entry for the end)."""

    joined: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def words(batch: list[bytes | None], lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+`; lower: with A-Z lower-cased. A null text has none."""
    batch = [t or b"" for t in batch]
    joined = b" ".join(batch) + b" "
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = span_hashes(data, starts, ends)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
    return Words(joined, hashes, starts, ends, np.searchsorted(starts, at))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of one text, and the word at which each starts."""
    n = len(found.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += found.hashes[i : i + n]
    of = found.text_of()
    at = np.flatnonzero(of[:n] == of[size - 1 :])
    return mix(total[at]), at


def window_checks(found: Words, at: np.ndarray, size: int) -> np.ndarray:
    """8 bits of each window that its hash doesn't depend on: from the lengths and the first and last bytes of its words."""
    data = np.frombuffer(found.joined, np.uint8)
    told = (found.ends - found.starts).astype(np.uint64) * np.uint64(65536) + data[found.starts].astype(np.uint64) * np.uint64(256) + data[found.ends - 1]
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9FB21C651E98DF25) + told[at + i]
    return (mix(total) >> np.uint64(56)).astype(np.uint8)
