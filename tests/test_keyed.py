"""Least-recently-used threads against a plain version."""

import random
import time
from collections import OrderedDict

from orrery.streaming import keyed


def plain_threads(calls, most, window=20, warn=3, stop=5):
    known, out = OrderedDict(), []
    for t, s, c in calls:
        recent = [*known.pop(t, []), c][-window:]
        known[t] = recent
        evicted = known.popitem(last=False)[0] if len(known) > most else None
        n = recent.count(c)
        out.append((t, s, c, n, "stop" if n >= stop else "warn" if n >= warn else "none", evicted))
    return out


def files(spark, path, frames, schema):
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def run(stream, path, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_the_oldest_thread_is_forgotten(spark, tmp_path):
    rng = random.Random(3)
    calls = [(f"t{min(rng.randint(0, 14), rng.randint(0, 14))}", s, rng.choice("ab")) for s in range(150)]
    stream = files(spark, f"{tmp_path}/in", [calls[:60], calls[60:110], calls[110:]], "thread string, seq long, call string")
    got = run(keyed.recent_threads(stream, "thread", "seq", "call", most=8, window=6), tmp_path, "lru")
    want = plain_threads(calls, 8, 6)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert any(e for *_, e in want) and {"warn", "stop"} <= {r[4] for r in want}


def test_the_101st_thread_forgets_the_first(spark, tmp_path):
    calls = [(f"t{k}", k, "x") for k in range(101)] + [("t0", 101, "x"), ("t2", 102, "x")]
    stream = files(spark, f"{tmp_path}/in", [calls], "thread string, seq long, call string")
    got = {r["seq"]: r for r in run(keyed.recent_threads(stream, "thread", "seq", "call"), tmp_path, "lru101").collect()}
    assert got[100]["evicted"] == "t0" and got[101]["repeats"] == 1 and got[101]["evicted"] == "t1" and got[102]["repeats"] == 2
