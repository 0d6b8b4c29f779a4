"""Small helpers that the operators share: the shared folder, written tables, Arrow batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter of wanted ids at most.
FILTER_BITS = 1 << 25
#: Text bytes that one slice of an Arrow batch holds at most (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, cut so that no slice holds many more than `limit` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def map_slices(df: DataFrame, column: str, make: Callable, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices: make(batch) returns a RecordBatch of the schema's columns or a list of such."""

    def run(batches):
        for part in slices(batches, column, limit):
            out = make(part)
            yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def per_worker(build: Callable) -> Callable:
    """build() once in each Python worker, on first use; its result isn't pickled with the task."""
    return _Once(build)


class _Once:
    def __init__(self, build: Callable):
        self.build = build
        self.made = None

    def __getstate__(self):
        return {"build": self.build, "made": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def __call__(self):
        if self.made is None:
            self.made = self.build()
        return self.made


def held_out(doc_id, mod: int = 4, fold: int = 2):
    """Whether crc32 of the id as text falls in the held-out fold; an id that is null is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == fold, F.lit(True))


def among(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """The rows of df whose value is in the written table `ids`, and few others: a filter of one hash, sized by their number,
    as a table of 64-bit words that is broadcast. It has FILTER_BITS / 64 rows at most; where the ids are too many for that,
    df comes back as it is. A join after it shuffles only rows that pass. Null values don't pass."""
    n = ids.count()
    if 4 * n > FILTER_BITS:
        return df
    bits = max(64, min(FILTER_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    at, word, found = (unused(name, df.columns) for name in ("at", "word", "found"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.select(place(id_column).alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))")).alias(found))
    met = df.filter(F.col(column).isNotNull()).withColumn(at, place(column)).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word)
    return met.filter(F.expr(f"shiftright({found}, CAST({at} & 63 AS INT)) & 1 = 1")).select(*df.columns)


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable]:
    """docs with the columns called like one of the names (in any case) renamed to names that nothing has, and a function
    that gives a frame's columns their own names again."""
    taken, moved = {c.lower() for c in docs.columns} | {c.lower() for c in names}, {}
    for c in docs.columns:
        if c.lower() in {x.lower() for x in names}:
            moved[c] = unused(c, taken)
            taken.add(moved[c].lower())
    return docs.withColumnsRenamed(moved), lambda frame: frame.withColumnsRenamed({new: old for old, new in moved.items()})


def unused(name: str, columns) -> str:
    """The name, with marks put before it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
