"""A keyed table that is changed in place: buckets of Parquet, copied on write, under a manifest that is swapped at once.

    path/manifest/00000003.json     the versions: which folder holds each bucket
    path/data/<batch>/bucket=7/     the rows of a bucket as a batch left them

A batch reads and rewrites only the buckets that its keys fall into. Readers follow the newest manifest, so that they see a batch whole or
not at all, whenever its writer ends; what a writer that failed has left is not in any manifest, and vacuum() deletes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.jobs.steps import read_text
from orrery.operators.store import exists, last_per_group, upsert


class Conflict(RuntimeError):
    """Another writer has put a version in place since this one read the table."""


@dataclass(frozen=True)
class Manifest:
    """A version of a table: its key, schema and number of buckets, and the folder of each bucket that has rows."""

    version: int
    key: str
    schema: str
    n_buckets: int
    buckets: dict[str, str]
    rows: int

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class StoredTable:
    """A stored table at a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, n_buckets: int = 64) -> StoredTable:
        """Store `rows`, whose keys must be there and differ (ValueError), as version 1. The number of buckets stays: about the table's
        greatest size over what a task should hold."""
        if exists(rows.sparkSession, f"{path}/manifest"):
            raise ValueError(f"there is a table at {path}")
        table = cls(rows.sparkSession, path, Manifest(0, key, rows.schema.json(), n_buckets, {}, 0))
        written, n = table._write(rows, None)
        faults = written.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).take(1)
        if faults:
            table._delete(f"data/{table._last}")
            raise ValueError(f"keys must be there and differ: {faults[0][0]!r}")
        return table._commit(table._folders(), n)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> StoredTable:
        """The table as its newest version, or another one, has it."""
        known = cls._versions(spark, path)
        if not known or version is not None and version not in known:
            raise ValueError(f"no table at {path}" if not known else f"no version {version} of {path}")
        told = read_text(spark, f"{path}/manifest/{version or known[-1]:08d}.json")
        return cls(spark, path, Manifest(**json.loads(told)))

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    # --- reading

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest.schema))

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest.n_buckets)).cast("int")

    def _read(self, buckets: list[str]) -> DataFrame:
        found = [f"{self.path}/{self.manifest.buckets[b]}" for b in buckets if b in self.manifest.buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows of this version."""
        return self._read([*self.manifest.buckets])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with the keys (a column of the key's name): only their buckets are read."""
        key = self.manifest.key
        wanted = keys.select(F.col(key).cast(self.schema[key].dataType)).where(F.col(key).isNotNull()).distinct()
        touched = [str(r[0]) for r in wanted.select(self.bucket_of(F.col(key)).alias("b")).distinct().collect()]  # at most n_buckets
        return self._read(touched).join(wanted, key, "left_semi")

    # --- writing

    def _write(self, rows: DataFrame, tasks: int | None) -> tuple[DataFrame, int]:
        self._last = uuid.uuid4().hex
        out = rows.withColumn("bucket", self.bucket_of(F.col(self.manifest.key)))
        out.repartition(tasks or self.manifest.n_buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{self._last}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{self._last}")
        return written, written.count()

    def _folders(self) -> dict[str, str]:
        """The buckets that the last batch wrote."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{self._last}")
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return {n.removeprefix("bucket="): f"data/{self._last}/{n}" for n in names if n.startswith("bucket=")}

    def _commit(self, buckets: dict[str, str], rows: int) -> StoredTable:
        """Put a version in place: its manifest is written aside and renamed, which readers see at once; Conflict if the version is there."""
        m = self.manifest
        new = Manifest(m.version + 1, m.key, m.schema, m.n_buckets, buckets, rows)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at, aside = jvm.Path(f"{self.path}/manifest/{new.version:08d}.json"), jvm.Path(f"{self.path}/manifest/{uuid.uuid4().hex}.new")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(aside, False)
        out.write(bytearray(new.text().encode()))
        out.close()
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            raise Conflict(f"{self.path} has a version {new.version} already")
        return StoredTable(self.spark, self.path, new)

    def upsert(self, batch: DataFrame, volatile: list[str], order: str | None = None) -> StoredTable:
        """The table after a batch: stored rows get the batch's values in the `volatile` columns (where it has one), new keys are added.

        Of several rows of a key, the one with the greatest `order` counts (without one, the batch must have each key once: ValueError).
        Columns that the batch lacks are null in it; rows without a key are refused. Buckets that no key of the batch falls into are
        neither read nor written. Conflict leaves the table as the other writer made it; a batch may be put in again, which changes
        nothing.
        """
        key, columns = self.manifest.key, self.schema.names
        given = batch.select(*[F.col(f"`{c}`").cast(self.schema[c].dataType).alias(c) if c in batch.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in columns], *([F.col(order).alias("__order")] if order else []))
        if order:
            given = last_per_group(given, [key], [F.desc_nulls_last("__order")]).drop("__order")
        told = given.select(key, self.bucket_of(F.col(key)).alias("b"))
        counts = told.groupBy("b").agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("none"), F.count_distinct(key).alias("keys")).collect()  # a row for each bucket
        if any(r["none"] for r in counts):
            raise ValueError("rows without a key")
        if any(r["n"] != r["keys"] for r in counts):
            raise ValueError("keys that repeat, and no order")
        if not counts:
            return self
        touched = [str(r["b"]) for r in counts]
        stored = self._read(touched)
        before = stored.count() if touched else 0
        _, n = self._write(upsert(stored, given, key, volatile).select(*columns), len(touched))
        return self._commit({**self.manifest.buckets, **self._folders()}, self.manifest.rows - before + n)

    def insert(self, batch: DataFrame, order: str | None = None) -> StoredTable:
        """The table with the batch's new keys; stored rows stay as they are."""
        return self.upsert(batch, [], order)

    # --- upkeep

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last `keep`, and the data that none of these has (no writer may be at work); returns how many
        batches' folders went."""
        known = self._versions(self.spark, self.path)
        used: set[str] = set()
        for v in known:
            if v in known[-keep:]:
                used |= {f.split("/")[1] for f in StoredTable.open(self.spark, self.path, v).manifest.buckets.values()}
            else:
                self._delete(f"manifest/{v:08d}.json")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName() not in used]
        for name in gone:
            self._delete(f"data/{name}")
        return len(gone)


def upsert_batches(path: str, volatile: list[str], order: str | None = None, tries: int = 5):
    """A handler of micro-batches that puts them into a stored table; a version that another writer made is read again and tried anew."""

    def run(batch: DataFrame, number: int) -> None:
        for k in range(tries):
            try:
                StoredTable.open(batch.sparkSession, path).upsert(batch, volatile, order)
                return
            except Conflict:
                if k == tries - 1:
                    raise

    return run
