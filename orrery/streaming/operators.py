"""Structured Streaming forms of the engine's operators."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicate(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def debounce(stream: DataFrame, keys: list[str], time: str, payload: str, flags: list[str], gap: str, delay: str = "0 seconds") -> DataFrame:
    """For each key and burst of events with no gap as long as `gap`: the last payload, and whether any event had each flag."""
    return stream.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap)).agg(F.max_by(payload, time).alias(payload), F.count("*").alias("n"), *[F.bool_or(f).alias(f) for f in flags])


def daily_quota(stream: DataFrame, key: str, time: str, quota: int, delay: str = "1 day") -> DataFrame:
    """Events of each key and UTC day, and whether they are over a quota."""
    return stream.withWatermark(time, delay).groupBy(key, F.window(time, "1 day")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > quota)


def progress(stream: DataFrame, keys: list[str], measures: dict[str, str], time: str | None = None, delay: str = "1 hour", every: str = "1 minute") -> DataFrame:
    """Running sums for update mode. With a time, sums are those of windows of `every`, which are let go `delay` after their end."""
    sums = [F.sum(c).alias(n) for n, c in measures.items()]
    if time is None:
        return stream.groupBy(*keys).agg(*sums)
    return stream.withWatermark(time, delay).groupBy(*keys, F.window(time, every)).agg(*sums)


def event_windows(stream: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows of event time (an extension)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"))


def repetitions(stream: DataFrame, thread: str, seq: str, call: str, window: int = 20, warn: int = 3, stop: int = 5, idle_ms: int | None = None) -> DataFrame:
    """For each call, how often it is among its thread's last `window` ones, itself included, and the action. State is those calls; with
    `idle_ms`, it is let go when the thread has been quiet for so long (for streams that go on: a query that stops when it has read
    what is there would wait for that)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [thread, seq, call, "repeats", "action"]
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        out = []
        for frame in frames:
            for s, c in frame.sort_values(seq)[[seq, call]].itertuples(index=False):
                recent = [*recent, c][-window:]
                n = recent.count(c)
                out.append((key[0], s, c, n, "stop" if n >= stop else "warn" if n >= warn else "none"))
        state.update((recent,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    types = dict(stream.dtypes)
    return stream.groupBy(thread).applyInPandasWithState(run, f"{thread} {types[thread]}, {seq} {types[seq]}, {call} {types[call]}, repeats int, action string", "recent array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def tool_counts(stream: DataFrame, thread: str, seq: str, tool: str, warn: int = 30, stop: int = 50, overrides: dict[str, tuple[int, int]] = {}, most: int = 100, idle_ms: int | None = None) -> DataFrame:  # noqa: B006
    """For each call, how often its thread has used the tool, and the action: a warning once when a tool's first limit is reached, stop
    from the second on; `overrides` has both limits of some tools.

    A thread's state holds its `most` tools that were used last, the oldest are forgotten; `idle_ms` as in repetitions().
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for frame in frames:
            for s, t in frame.sort_values(seq)[[seq, tool]].itertuples(index=False):
                n = counts.pop(t, 0) + 1
                counts[t] = n  # the last used stands last
                if len(counts) > most:
                    counts.pop(next(iter(counts)))
                low, high = overrides.get(t, (warn, stop))
                out.append((key[0], s, t, n, "stop" if n >= high else "warn" if n == low else "none"))
        state.update((list(counts), list(counts.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[thread, seq, tool, "uses", "action"])

    types = dict(stream.dtypes)
    return stream.groupBy(thread).applyInPandasWithState(run, f"{thread} {types[thread]}, {seq} {types[seq]}, {tool} {types[tool]}, uses int, action string", "tools array<string>, uses array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def replay(log: DataFrame, run: str, after: str | None, run_column: str = "run_id", id_column: str = "event_id", most: int = 256) -> DataFrame:
    """Events of a run that a reader hasn't seen: after its last id among the last `most`, or all of these if it isn't there."""
    kept = log.where(F.col(run_column) == run).orderBy(F.desc(id_column)).limit(most)
    if after is not None and not kept.where(F.col(id_column) == after).isEmpty():
        kept = kept.where(F.col(id_column) > after)
    return kept.orderBy(id_column)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handle what is there in micro-batches with a batch function; the checkpoint lets a failed batch run again."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def buffered(handle: Callable[[DataFrame, int], None], folder: str, threshold: int) -> Callable[[DataFrame, int], None]:
    """A handler of micro-batches that keeps their rows in a folder until there are `threshold`, then hands over all of them at once.

    If that fails, the rows stay and are handed over again with the next batch. A batch that is run again replaces its own rows. What
    waits when the stream ends goes by flush().
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if spark.read.parquet(folder).count() < threshold:
            return
        try:
            flush(spark, handle, folder, number)
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"batch {number} is kept for the next: {e}", stacklevel=2)

    return run


def flush(spark: SparkSession, handle: Callable[[DataFrame, int], None], folder: str, number: int = -1) -> int:
    """Hand over the rows that wait in a buffered() folder, however few: at the end of a stream. Returns their number; if handing them
    over fails, they stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    waiting = spark.read.parquet(folder).drop("batch")
    n = waiting.count()
    if n:
        handle(waiting, number)
    fs.delete(path, True)
    return n
