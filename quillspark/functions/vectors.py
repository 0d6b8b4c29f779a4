"""Vectors as arrays of floats, and as packed little-endian binary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow_function


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null if either is the zero vector."""
    return 1 - F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


@arrow_function("binary", arrays=True)
def pack(v: pa.Array) -> pa.Array:
    """Little-endian 32-bit floats: the batch's own buffer of floats, cut at the vectors' bounds."""
    lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    floats = pa.py_buffer(np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), "<f4"))
    whole = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(_offsets(4 * lengths)), floats])
    return pc.if_else(v.is_valid(), whole, pa.scalar(None, pa.binary()))


@arrow_function("array<float>", arrays=True)
def unpack(b: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False) // 4
    floats = np.frombuffer(b"".join(x for x in b.to_pylist() if x), "<f4")
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths)), pa.array(floats, pa.float32()), mask=b.is_null())
