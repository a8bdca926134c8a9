"""Jobs of steps whose results are kept under what made them, so that a job that is run again goes on where its inputs differ.

A step's key is a digest of its name, version and parameters and of its inputs' keys; a source's key comes from its files. A result is a
Parquet folder named by its key, with a side-car of counts that is written last: a folder without one was cut short, and is made anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.store import exists

#: Files up to this size are told by their content, larger ones by name, length and time of change.
CONTENT_BYTES = 256 << 20


def files_key(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """The key of all files below a path: names and contents (of very large files length and time); their order has no say.

    The files' digests are summed where they are, so that only one row comes to the driver however many there are.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    listed = found.load(path).select("path", "length", "modificationTime")
    small = found.load(path).where(F.col("length") <= CONTENT_BYTES).select("path", F.sha2("content", 256).alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    told = small.select(F.sha2(F.concat_ws("\n", name, "content"), 256).alias("d")).unionByName(
        listed.where(F.col("length") > CONTENT_BYTES).select(F.sha2(F.concat_ws("\n", name, F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256).alias("d"))
    )
    lanes = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    row = told.agg(F.count("*").alias("n"), *[c.alias(f"s{k}") for k, c in enumerate(lanes)]).first()
    return hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()


@dataclass(frozen=True)
class Step:
    """A step's name, the function from its inputs' tables to its own, their names, further parameters, the counts of its side-car (from
    the inputs' tables and its own), and a version that is raised when the function changes what it makes."""

    name: str
    make: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    parameters: dict[str, object] = field(default_factory=dict)
    counts: Callable[..., dict[str, int]] | None = None
    version: int = 1

    def key(self, inputs: list[str]) -> str:
        told = json.dumps([self.name, self.version, self.parameters, inputs], sort_keys=True, ensure_ascii=False)
        return hashlib.sha256(told.encode()).hexdigest()


@dataclass
class Result:
    """A step's table, its counts, and whether it was there already."""

    table: DataFrame
    counts: dict[str, int]
    resumed: bool
    path: str


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text in place at once, through Hadoop's file systems: readers see the old text or the new."""
    at, fs = _file(spark, path)
    new = _file(spark, f"{path}.new")[0]
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(new, at):  # some file systems don't replace
        fs.delete(at, False)
        fs.rename(new, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text, or None if it isn't there."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return None
    n = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(int(n))).decode()
    finally:
        stream.close()


def run_job(spark: SparkSession, steps: list[Step], sources: dict[str, tuple[str, Callable[[], DataFrame]]], folder: str) -> dict[str, Result]:
    """Run the steps in their order; `sources` has a key and a reader for each table that no step makes.

    A step whose key is known is read from `folder` and not made again; nor are, then, the sources that only such steps need. Results of
    other keys stay until prune(). Fails with KeyError if a step names an input that comes after it.
    """
    keys = {n: k for n, (k, _) in sources.items()}
    made: dict[str, Result] = {}
    for step in steps:
        keys[step.name] = key = step.key([keys[n] for n in step.inputs])
        path = f"{folder}/{step.name}-{key[:24]}"
        told = read_text(spark, f"{path}/counts.json")
        if told is None:
            inputs = [made[n].table if n in made else sources[n][1]() for n in step.inputs]
            step.make(*inputs, **step.parameters).write.mode("overwrite").parquet(f"{path}/data")
            table = spark.read.parquet(f"{path}/data")
            counts = step.counts(*inputs, table) if step.counts else {"rows": table.count()}
            write_text(spark, f"{path}/counts.json", json.dumps({"stage": step.name, **counts}, ensure_ascii=False))
        else:
            table, counts = spark.read.parquet(f"{path}/data"), {k: v for k, v in json.loads(told).items() if k != "stage"}
        made[step.name] = Result(table, counts, told is not None, path)
    return made


def prune(spark: SparkSession, results: dict[str, Result], folder: str) -> int:
    """Delete what earlier runs left below the folder; returns how many results went."""
    if not exists(spark, folder):
        return 0
    kept = {r.path.rpartition("/")[2] for r in results.values()}
    at, fs = _file(spark, folder)
    gone = 0
    for f in fs.listStatus(at):
        if f.getPath().getName() not in kept:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
