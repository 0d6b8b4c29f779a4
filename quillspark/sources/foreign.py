"""Tables of another program's SQLite file, read in ranges of an integer key, with filters and columns handed to the file.

The file must lie where every executor reads it, and is opened read-only. Spark's filters by comparison, equality, lists and
null tests are part of the query that each range sends; with spark.sql.python.filterPushdown.enabled the plan shows them at
the scan.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

KINDS = {"INT": T.LongType(), "BIGINT": T.LongType(), "INTEGER": T.LongType(), "TIMESTAMP": T.DoubleType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}
COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def condition(f: ds.Filter) -> tuple[str, list] | None:
    """A filter as SQL with parameters; null for one that the file can't answer as Spark does."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = _quoted(f.attribute[0])
    if type(f) in COMPARED and isinstance(f.value, (int, float, str)):
        return f"{column} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, ds.In) and f.value and all(isinstance(v, (int, float, str)) for v in f.value):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, ds.IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, ds.IsNotNull):
        return f"{column} IS NOT NULL", []
    return None


class SqliteTable(ds.DataSource):
    """Options: path, table, key (an integer column; without one the row number of the file), parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as file:
            found = file.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        return T.StructType([T.StructField(name, KINDS.get((kind or "").upper().split("(")[0], T.StringType())) for _, name, kind, *_ in found])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Range(ds.InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


class _Reader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.key = options["path"], options["table"], options.get("key", "rowid")
        self.parts, self.columns = int(options.get("parts", 8)), schema.fieldNames()
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            told = condition(f)
            if told is None:
                yield f
            else:
                self.where.append(told)

    def _filtered(self, *more: tuple[str, list]) -> tuple[str, list]:
        every = [*self.where, *more]
        return (" WHERE " + " AND ".join(c for c, _ in every) if every else ""), [v for _, vs in every for v in vs]

    def partitions(self) -> list[ds.InputPartition]:
        """Ranges of the key's values among the rows that pass the filters, and one for rows without a key."""
        key = _quoted(self.key)
        where, values = self._filtered()
        with _open(self.path) as file:
            low, high, n, keyed = file.execute(f"SELECT min({key}), max({key}), count(*), count({key}) FROM {_quoted(self.table)}{where}", values).fetchone()
        out: list[ds.InputPartition] = [_Range(None, None)] if n > keyed or not n else []
        if keyed:
            step = -(-(high - low + 1) // self.parts)
            out += [_Range(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]
        return out

    def read(self, partition: ds.InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        key = _quoted(self.key)
        own = (f"{key} IS NULL", []) if low is None else (f"{key} BETWEEN ? AND ?", [low, high])
        where, values = self._filtered(own)
        with _open(self.path) as file:
            yield from file.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)}{where}", values)


def sqlite_table(spark: SparkSession, path: str, table: str, key: str = "rowid", parts: int = 8) -> DataFrame:
    """A table of an SQLite file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, key=key, parts=str(parts)).load()
