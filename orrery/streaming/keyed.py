"""Keyed state with eviction: a processor of transformWithStateInPandas, whose state the RocksDB store keeps.

Sessions that run it need `spark.sql.streaming.stateStore.providerClass` set to PROVIDER (keep_state() does it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, which such processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _RecentThreads(StatefulProcessor):
    """Of a shard: the threads used last, each with its last calls and when it was used, by the shard's own count of calls."""

    def __init__(self, columns: tuple[str, str, str], most: int, window: int, warn: int, stop: int):
        self.columns, self.most, self.window, self.warn, self.stop = columns, most, window, warn, stop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.threads = handle.getMapState("threads", "thread string", "used long, recent array<string>")
        self.calls = handle.getValueState("calls", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        thread, seq, call = self.columns
        n = self.calls.get()[0] if self.calls.exists() else 0
        known = {k[0]: (v[0], list(v[1])) for k, v in self.threads.iterator()}  # `most` at most
        changed, gone, out = set(), set(), []
        frame = pd.concat(list(rows)).sort_values([seq, thread], kind="stable")
        for t, s, c in frame[[thread, seq, call]].itertuples(index=False):
            n += 1
            recent = [*known.get(t, (0, []))[1], c][-self.window :]
            known[t] = (n, recent)
            changed.add(t)
            gone.discard(t)
            evicted = None
            if len(known) > self.most:
                evicted = min(known, key=lambda k: known[k][0])
                del known[evicted]
                changed.discard(evicted)
                gone.add(evicted)
            repeats = recent.count(c)
            out.append((t, s, c, repeats, "stop" if repeats >= self.stop else "warn" if repeats >= self.warn else "none", evicted))
        for t in changed:
            self.threads.updateValue((t,), known[t])
        for t in gone:
            if self.threads.containsKey((t,)):
                self.threads.removeKey((t,))
        self.calls.update((n,))
        yield pd.DataFrame(out, columns=["thread", "seq", "call", "repeats", "action", "evicted"])

    def close(self) -> None:
        pass


def recent_threads(stream: DataFrame, thread: str, seq: str, call: str, most: int = 100, shards: int = 1, window: int = 20, warn: int = 3, stop: int = 5) -> DataFrame:
    """For each call, how often it is among its thread's last `window` ones, the action, and the thread that was forgotten for it.

    Only the `most` threads used last are remembered, over all threads of a shard: one more forgets the one that was used longest ago,
    whose next call starts anew. One shard remembers as a single process does; with more, threads are dealt by their hash, and `most`
    holds for each. `seq` orders the calls of a batch, over threads.
    """
    keep_state(stream.sparkSession)
    given = stream.select(F.pmod(F.xxhash64(F.col(thread).cast("string")), F.lit(shards)).alias("shard"), F.col(thread).cast("string").alias("thread"), F.col(seq).cast("long").alias("seq"), F.col(call).alias("call"))
    processor = _RecentThreads(("thread", "seq", "call"), most, window, warn, stop)
    return given.groupBy("shard").transformWithStateInPandas(processor, "thread string, seq long, call string, repeats int, action string, evicted string", "Append", "None")
