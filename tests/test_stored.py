"""The stored table: batches, versions, failures between write and swap, and other writers."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import aggregate
from orrery.sources import stored
from orrery.sources.stored import StoredTable

SCHEMA = "id string, likes long, title string, at long"


def rows(table):
    return {r["id"]: (r["likes"], r["title"], r["at"]) for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i, f"t{i}", 0) for i in range(50)], SCHEMA)
    return StoredTable.create(df, f"file://{tmp_path}/t", "id", n_buckets=8)


def test_batches_against_a_dictionary(spark, table):
    rng = random.Random(1)
    want, before = {f"k{i}": (i, f"t{i}", 0) for i in range(50)}, table
    for n in range(4):
        batch = [(f"k{rng.randint(0, 80)}", rng.choice([None, rng.randint(100, 999)]), rng.choice([None, f"new{n}"]), 10 * n + k) for k in range(12)]
        table = table.upsert(spark.createDataFrame(batch, SCHEMA), ["likes"], order="at")
        last = {}
        for r in batch:
            last[r[0]] = r
        for k, likes, title, at in last.values():
            old = want.get(k, (None, None, None))
            want[k] = (old[0] if likes is None else likes, title if old[1] is None else old[1], at if old[2] is None else old[2])
        assert rows(table) == want and table.manifest.rows == len(want) and table.manifest.version == n + 2
    assert rows(before) == {f"k{i}": (i, f"t{i}", 0) for i in range(50)}
    assert rows(StoredTable.open(spark, table.path)) == want and rows(StoredTable.open(spark, table.path, 1)) == rows(before)


def test_only_touched_buckets_are_written(spark, table):
    after = table.upsert(spark.createDataFrame([("k1", 5)], "id string, likes long"), ["likes"])
    changed = {b for b, f in after.manifest.buckets.items() if table.manifest.buckets.get(b) != f}
    assert len(changed) == 1 and rows(after)["k1"] == (5, "t1", 0)
    key = spark.createDataFrame([("k1",), ("nobody",), (None,)], "id string")
    found = after.lookup(key)
    assert [r["likes"] for r in found.collect()] == [5]
    assert len(found.inputFiles()) < len(after.read().inputFiles())
    assert after.upsert(spark.createDataFrame([], SCHEMA), ["likes"]) is after


def test_a_writer_that_fails_before_the_swap_leaves_no_trace(spark, table, monkeypatch):
    want = rows(table)
    batch = spark.createDataFrame([("k1", 999, "x", 1), ("new", 1, "y", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(batch, ["likes"])
    again = StoredTable.open(spark, table.path)
    assert rows(again) == want and again.manifest.version == 1
    folder = Path(table.path.removeprefix("file://"))
    assert len(list((folder / "data").iterdir())) == 2
    assert again.vacuum() == 1 and rows(again) == want
    done = again.upsert(batch, ["likes"])
    assert rows(done) == want | {"k1": (999, "t1", 0), "new": (1, "y", 1)}
    assert rows(done.upsert(batch, ["likes"])) == rows(done)  # put in again, it changes nothing


def test_two_writers_of_one_version(spark, table):
    first, second = StoredTable.open(spark, table.path), StoredTable.open(spark, table.path)
    first.upsert(spark.createDataFrame([("a", 1, "a", 1)], SCHEMA), [])
    with pytest.raises(stored.Conflict):
        second.upsert(spark.createDataFrame([("b", 1, "b", 1)], SCHEMA), [])
    stored.upsert_batches(table.path, ["likes"])(spark.createDataFrame([("b", 2, "b", 1)], SCHEMA), 0)
    now = StoredTable.open(spark, table.path)
    assert now.manifest.version == 3 and {"a", "b"} <= set(rows(now))
    assert now.vacuum(keep=2) >= 0 and rows(StoredTable.open(spark, table.path, 2)).keys() >= {"a"}
    with pytest.raises(ValueError, match="no version 1"):
        StoredTable.open(spark, table.path, 1)


def test_keys_must_be_there_and_differ(spark, table, tmp_path):
    twice, none = spark.createDataFrame([("a", 1), ("a", 2)], "id string, likes long"), spark.createDataFrame([(None, 1)], "id string, likes long")
    for bad in (twice, none):
        with pytest.raises(ValueError):
            table.upsert(bad, ["likes"])
        with pytest.raises(ValueError, match="must be there and differ"):
            StoredTable.create(bad, f"file://{tmp_path}/u", "id")
    with pytest.raises(ValueError, match="there is a table"):
        StoredTable.create(twice, table.path, "id")
    with pytest.raises(ValueError, match="no table"):
        StoredTable.open(spark, f"file://{tmp_path}/nothing")
    assert json.loads(table.manifest.text())["key"] == "id"


def test_streams_put_batches_into_the_table(spark, table, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame([(f"s{k}", k, "t", k), ("k0", 100 + k, "no", k)], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(stored.upsert_batches(table.path, ["likes"], "at")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = rows(StoredTable.open(spark, table.path))
    assert {"s0", "s1", "s2"} <= set(got) and got["k0"][0] in (100, 101, 102) and got["k0"][1] == "t0"


@pytest.mark.parametrize("kind", ["few", "spread", "heavy", "ends", "tiny"])
def test_quantiles_by_rank_selection(spark, kind):
    rng = np.random.default_rng(7)
    x = {
        "few": rng.integers(0, 5, 4000).astype(float),
        "spread": rng.lognormal(0, 4, 4000),
        "heavy": np.concatenate([np.full(3000, 2.5), rng.normal(0, 1e9, 1000)]),
        "ends": np.concatenate([np.full(2000, -1.0), np.full(2000, 1.0)]),
        "tiny": np.array([3.0, 1.0]),
    }[kind]
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 7, "v double").withColumns({"w": F.col("v").cast("long"), "none": F.lit(None).cast("int")})
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for most in (50, 100_000):
        got = aggregate.exact_quantiles(df, ["v", "w", "none"], shares, most=most, accuracy=200)
        assert np.allclose(got["v"], np.quantile(x, shares), rtol=1e-12, atol=0) and got["none"] == [None] * 6
        assert np.allclose(got["w"], np.quantile(np.trunc(x).astype(np.int64), shares), rtol=1e-9)
    assert aggregate.exact_quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}
