"""SQLite databases as a data source of Spark: partitions are ranges of row ids, read on the executors.

A database must lie in a folder that all executors see. Servers (Postgres and others) are read by Spark's own jdbc format.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def connect(path: str) -> sqlite3.Connection:
    """A connection that only reads."""
    return sqlite3.connect(f"file:{local(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    with closing(connect(path)) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def spark_type(declared: str) -> T.DataType:
    """The type of a column by the affinity of its declared type."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.StringType()


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int):
        self.path, self.table, self.columns, self.size = path, table, schema.fields, rows

    def partitions(self) -> list[Rows]:
        with closing(connect(self.path)) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return [Rows(0, 0)] if low is None else [Rows(k, min(k + self.size, high + 1)) for k in range(low, high + 1, self.size)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        kinds = [(f.dataType, f.name) for f in self.columns]
        names = ", ".join(quoted(n) for _, n in kinds)

        def fit(v, kind):
            if v is None or isinstance(kind, T.BinaryType):
                return v.encode() if isinstance(v, str) else v
            try:
                return int(v) if isinstance(kind, T.LongType) else float(v) if isinstance(kind, T.DoubleType) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
            except (TypeError, ValueError):  # a value that isn't of its column's type
                return None

        with closing(connect(self.path)) as c:
            for row in c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(fit(v, k) for v, (k, _) in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """Options: path, table, rows (row ids of a partition, 100,000)."""

    @classmethod
    def name(cls) -> str:
        return "orrery_sqlite"

    def schema(self) -> T.StructType:
        with closing(connect(self.options["path"])) as c:
            found = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return T.StructType([T.StructField(r[1], spark_type(r[2] or "")) for r in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("rows", 100_000)))


def read_table(spark: SparkSession, path: str, table: str, rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file; null for values that aren't of their column's type."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).option("path", path).option("table", table).option("rows", rows).load()


def read_platform_posts(spark: SparkSession, path: str, table: str, columns: dict[str, str], newest: str = "add_ts") -> DataFrame:
    """The posts of a platform's table, the last added first, under common names (name -> column; a column that isn't there is null)."""
    from pyspark.sql import functions as F

    df = read_table(spark, path, table)
    ordered = df.orderBy(F.desc(newest)) if newest in df.columns else df
    return ordered.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(n) for n, c in columns.items()])
