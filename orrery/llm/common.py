"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in an Arrow batch at most (one row may have more): a batch of long texts holds few of them.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ARROW_ROWS and ARROW_BYTES; settings that are tighter already stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    told = re.fullmatch(r"(\d+)b?", spark.conf.get(size).lower())
    if not told or not 0 < int(told[1]) <= ARROW_BYTES:
        spark.conf.set(size, str(ARROW_BYTES))


class Kept(dict):
    """Values of keys, computed when they are first asked for, of which the last asked for are kept: between `most` / 2 and `most`."""

    def __init__(self, compute: Callable, most: int, longest: int = 64):
        self.compute, self.half, self.longest, self.older = compute, most // 2, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local folder of our own where it
    is unset and all run in one process (tests); elsewhere it must be set (ValueError)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = getattr(sc, "_orrery_dir", None)
        if configured is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            configured = sc._orrery_dir = "file://" + tempfile.mkdtemp(prefix="orrery-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, remembered for drop_folders()."""
    path = f"{shared_dir(spark).rstrip('/')}/orrery-{uuid.uuid4().hex}"
    folders(spark).append(path)
    return path


def folders(spark: SparkSession) -> list[str]:
    """The folders that this application has made below the shared one and that are still there, in the order of making."""
    sc = spark.sparkContext
    if not hasattr(sc, "_orrery_folders"):
        sc._orrery_folders = []
    return sc._orrery_folders


def drop_folders(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the folders made from the `first` on, up to the `last`: to be called when all that was read from them has been written."""
    made = folders(spark)
    for path in made[first:last]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del made[first:last]


def settled(df: DataFrame, name: str, first: int) -> DataFrame:
    """shared_table(), and all folders made from the `first` on are deleted: `df` was the last to read from them."""
    out = shared_table(df, name)
    drop_folders(df.sparkSession, first, -1)
    return out


#: Rows of a table of row numbers that is broadcast (16 bytes each or so in a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose key isn't in the written table `rows`. If that is small, `df` stays where it is."""
    known = rows.select(key)
    return df.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, key, "left_anti")


def placed(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The rows of a written table with `pos`, their place in their group by the order's columns (from 0, nulls first), and `n`, the
    group's size. Where groups and order tell all rows apart, no group is held by one task, however large it is.

    Rows are sorted by ranges and written with their place in their range; what a range holds of a group is counted, and the counts of
    the ranges before give the place in the whole.
    """
    keys = [F.col(f"`{c}`") for c in [*groups, *order]]
    written = shared_table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "placed")
    written = written.withColumn("__part", F.shiftright("__at", 33))
    runs = written.groupBy("__part", *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*groups)
    starts = runs.select(
        F.col("__part").alias("__p"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        "__first",
        (F.sum("__rows").over(whole.orderBy("__part")) - F.col("__rows")).alias("__start"),
        F.sum("__rows").over(whole).alias("n"),
    )
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return written.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__at") - F.col("__first")).alias("pos"), "n")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to write (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def type_of(df: DataFrame, column: str) -> str:
    """A column's type, as it is written in a schema."""
    return df.select(column).schema[0].dataType.simpleString()


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def tidy() -> None:
    """Give memory that a task has freed back to the system: Python workers stay for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def add_columns(df: DataFrame, make: Callable[[], Callable[..., list[pa.Array]]], inputs: list[str], fields: list[T.StructField]) -> DataFrame:
    """Add columns computed in Arrow batches, with all columns of `df` kept; those named like a new one are replaced.

    `make` runs once in each task and returns a function from the input columns (Arrow arrays of one batch) to the new columns.
    """
    bound_batches(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    base = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(*batch.columns[n:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=[*kept, *names])
        tidy()

    return base.mapInArrow(run, schema)
