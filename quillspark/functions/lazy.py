"""Arrow functions that are made on their first use, as their types need a session to be read, and rows made of texts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that are taken from a batch at a time (a longer text is taken alone), and rows that are given back at a time.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2000


def arrow_function(kind: str, arrays: bool = False) -> Callable:
    """A function over pandas series or, with arrays, over Arrow arrays."""

    def wrap(f: Callable) -> Callable:
        made: list = []

        @functools.wraps(f)
        def column(*columns):
            if not made:
                made.append((F.arrow_udf if arrays else F.pandas_udf)(f, kind))
            return made[0](*columns)

        return column

    return wrap


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, cut so that no slice holds many more than SLICE_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def rows_of(df: DataFrame, columns: list[str], keep: list[str], make: Callable, schema: str | StructType) -> DataFrame:
    """For each row of df the rows (dicts of the schema's columns) that make(*values of columns) gives, beside the row's columns
    `keep`. The first of the columns is a text; a worker holds what comes of about SLICE_BYTES of it at once, however large the
    batches are that Spark sends."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([df.schema[c] for c in keep] + kind.fields)
    made = to_arrow_schema(kind)
    names = [*keep, *kind.names]

    def run(batches):
        for part in slices(batches, columns[0]):
            own, at, out = part.select(keep), [], []

            def told():
                return pa.RecordBatch.from_arrays([*own.take(pa.array(at, pa.int64())).columns, *pa.RecordBatch.from_pylist(out, schema=made).columns], names=names)

            for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in columns))):
                for row in make(*values):
                    at.append(i)
                    out.append(row)
                    if len(out) >= SLICE_ROWS:
                        yield told()
                        at, out = [], []
            if out:
                yield told()

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, whole)
