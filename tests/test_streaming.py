import pytest
from pyspark.sql import functions as F

from orrery.operators import windows
from orrery.streaming import operators


def test_repetitions_match_their_batch_twin(spark, tmp_path):
    rows = [(t, s, "ab"[(s * s + t) % 3 % 2]) for t in range(3) for s in range(40)]
    df = spark.createDataFrame(rows, "thread int, seq int, call string").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = operators.repetitions(stream, "thread", "seq", "call")
    q = out.writeStream.format("memory").queryName("reps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(tuple(r) for r in d.select("thread", "seq", "repeats", "action").collect())
    assert key(spark.table("reps")) == key(windows.repetitions(df, "thread", "seq", "call"))


def test_deduplicate_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")], "id int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = operators.deduplicate(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "id", "t")
    operators.run_batches(stream, lambda b, i: seen.extend(r.id for r in b.collect()), f"{tmp_path}/c")
    assert sorted(seen) == [1, 2]


def started(spark, tmp_path, stream, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


def events(spark, tmp_path, rows, schema):
    """Rows as a stream, and a last one far later that closes all windows."""
    df = spark.createDataFrame(rows, schema).withColumn("t", F.to_timestamp("t")).coalesce(1)
    df.write.parquet(f"{tmp_path}/in/a")
    late = spark.createDataFrame([(*["z" if f.dataType.simpleString() == "string" else 0 if f.dataType.simpleString() == "int" else False for f in df.schema if f.name != "t"],)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "t")).withColumn("t", F.to_timestamp(F.lit("2030-01-01 00:00:00"))).select(*df.columns)
    late.write.parquet(f"{tmp_path}/in/b")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(f"{tmp_path}/in"), df


def test_debounce_gives_bursts(spark, tmp_path):
    rows = [("a", 1, False, "2024-01-01 00:00:00"), ("a", 2, True, "2024-01-01 00:00:20"), ("a", 3, False, "2024-01-01 00:05:00"), ("b", 4, False, "2024-01-01 00:00:10")]
    stream, _ = events(spark, tmp_path, rows, "k string, p int, f boolean, t string")
    out = started(spark, tmp_path, operators.debounce(stream, ["k"], "t", "p", ["f"], "1 minute"))
    assert sorted((r.k, r.p, r.n, r.f) for r in out.where("k != 'z'").collect()) == [("a", 2, 2, True), ("a", 3, 1, False), ("b", 4, 1, False)]


def test_quota_windows_and_progress(spark, tmp_path):
    rows = [("a", i, f"2024-01-01 0{i}:00:00") for i in range(3)] + [("a", 9, "2024-01-02 01:00:00")]
    stream, df = events(spark, tmp_path, rows, "k string, p int, t string")
    out = started(spark, tmp_path, operators.daily_quota(stream, "k", "t", 2))
    assert sorted((str(r.window.start)[:10], r.n, r.over) for r in out.where("k = 'a'").collect()) == [("2024-01-01", 3, True), ("2024-01-02", 1, False)]
    hours = operators.event_windows(df, "t", ["k"], "2 hours")
    assert sorted(r.n for r in hours.collect()) == [1, 1, 2]
    assert operators.progress(df, ["k"], {"s": "p"}).first().s == 12 and sorted(r.s for r in operators.progress(df, ["k"], {"s": "p"}, "t", every="1 day").collect()) == [3, 9]


def test_tool_counts_warn_once_and_forget_the_oldest(spark, tmp_path):
    calls = ["a"] * 4 + ["b", "c", "d", "a", "b"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(calls)], "thread int, seq int, tool string").coalesce(1)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = started(spark, tmp_path, operators.tool_counts(stream, "thread", "seq", "tool", warn=2, stop=4, overrides={"b": (1, 9)}, most=3))
    got = [(r.tool, r.uses, r.action) for r in out.orderBy("seq").collect()]
    assert got == [("a", 1, "none"), ("a", 2, "warn"), ("a", 3, "none"), ("a", 4, "stop"), ("b", 1, "warn"), ("c", 1, "none"), ("d", 1, "none"), ("a", 1, "none"), ("b", 1, "warn")]


def test_replay_after_what_was_seen(spark):
    log = spark.createDataFrame([("r", i) for i in range(5)] + [("x", 9)], "run_id string, event_id int")
    ids = lambda after, most=256: [r.event_id for r in operators.replay(log, "r", after, most=most).collect()]
    assert ids(None) == [0, 1, 2, 3, 4] and ids(2) == [3, 4] and ids(77) == [0, 1, 2, 3, 4] and ids(0, most=2) == [3, 4]


def test_buffered_rows_are_handed_over_again_after_a_failure(spark, tmp_path):
    seen, fails = [], [True]

    def handle(batch, number):
        if fails.pop() if fails else False:
            raise RuntimeError("not now")
        seen.append((number, sorted(r.id for r in batch.collect())))

    run = operators.buffered(handle, f"file://{tmp_path}/wait", 3)
    run(spark.createDataFrame([(1,), (2,)], "id int"), 0)
    assert seen == []
    with pytest.warns(UserWarning):
        run(spark.createDataFrame([(3,)], "id int"), 1)
    run(spark.createDataFrame([(3,)], "id int"), 1)
    run(spark.createDataFrame([(4,)], "id int"), 2)
    assert seen == [(1, [1, 2, 3])]


def test_what_waits_at_the_end_is_flushed(spark, tmp_path):
    got, folder = [], f"{tmp_path}/buffer"
    take = lambda df, number: got.append((number, sorted(r.id for r in df.collect())))
    handler = operators.buffered(take, folder, 3)
    handler(spark.range(0, 2), 0)
    handler(spark.range(2, 4), 1)
    handler(spark.range(4, 5), 2)
    assert got == [(1, [0, 1, 2, 3])]

    def fails(df, number):
        raise OSError("away")

    with pytest.raises(OSError):
        operators.flush(spark, fails, folder)
    assert operators.flush(spark, take, folder) == 1 and got[1] == (-1, [4]) and operators.flush(spark, take, folder) == 0
