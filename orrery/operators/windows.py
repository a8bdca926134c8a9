"""Rankings, budgets and order-dependent folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repetitions(calls: DataFrame, thread: str, seq: str, call: str, window: int = 20, warn: int = 3, stop: int = 5) -> DataFrame:
    """Adds repeats (how often the row's call is among the thread's last `window` ones, itself included) and action."""
    w = Window.partitionBy(thread).orderBy(seq).rowsBetween(-(window - 1), 0)
    n = F.size(F.filter(F.collect_list(call).over(w), lambda x: x == F.col(call)))
    return calls.withColumn("repeats", n).withColumn("action", F.when(F.col("repeats") >= stop, "stop").when(F.col("repeats") >= warn, "warn").otherwise("none"))


def running_counts(calls: DataFrame, thread: str, tool: str, seq: str) -> DataFrame:
    """Adds uses: how often the thread has used the row's tool so far."""
    return calls.withColumn("uses", F.count("*").over(Window.partitionBy(thread, tool).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows of each group in order until the first that overruns the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def greedy_pick(df: DataFrame, group: str, rank: str, key: str, cost: str, total: float, single: float, most: int) -> DataFrame:
    """Rows of each group in rank order that fit: each at most `single`, all together at most `total`, no key twice, at most `most`.

    What doesn't fit is skipped, not an end. The fold is within one group's array: for short groups (items of one message list).
    """
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col(cost).cast("double").alias("c")))).alias("rows"))
    empty = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<string>").alias("picked"))
    fits = lambda acc, x: (x["c"] <= single) & (acc["spent"] + x["c"] <= total) & ~F.array_contains(acc["picked"], x["k"]) & (F.size(acc["picked"]) < most)
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["spent"] + x["c"]).alias("spent"), F.array_append(acc["picked"], x["k"]).alias("picked"))).otherwise(acc)
    return rows.select(group, F.aggregate("rows", empty, step).alias("f")).select(group, "f.spent", "f.picked")


def call_groups(messages: DataFrame, thread: str, seq: str, is_call: Column) -> DataFrame:
    """Adds call_group: a call and the rows that follow it up to the next call share a number."""
    return messages.withColumn("call_group", F.sum(is_call.cast("int")).over(Window.partitionBy(thread).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def chunks(df: DataFrame, order: list[Column], size: int, within: list[str] = ()) -> DataFrame:
    """Adds chunk: rows in order, `size` to a chunk, counted within some columns' groups."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1) / size).cast("int"))


def stratified(df: DataFrame, key: str, stratum: Column, n: int, strata: list[str], remainder: list[str], seed: int) -> DataFrame:
    """At most floor(n / strata) rows of each stratum, the remainder going to strata in order; chosen by a seeded hash. A stratum with
    too few rows gives what it has."""
    each, left = divmod(n, len(strata))
    quota = F.coalesce(*[F.when(F.col("stratum") == s, F.lit(each + (s in remainder[:left]))) for s in strata], F.lit(0))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = df.withColumn("stratum", stratum).withColumn("pick", F.row_number().over(Window.partitionBy("stratum").orderBy(order, key)))
    return ranked.where(F.col("pick") <= quota)


def recent_flags(messages: DataFrame, thread: str, turn: str, role: str, text: str, pattern: str, last: int = 6, who: str = "user") -> DataFrame:
    """For each thread, whether a turn of `who` among its last ones matches a pattern."""
    w = Window.partitionBy(thread).orderBy(F.desc(turn))
    recent = messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last)
    return recent.groupBy(thread).agg(F.coalesce(F.bool_or((F.col(role) == who) & F.col(text).rlike(pattern)), F.lit(False)).alias("flagged"))


def memory_messages(messages: DataFrame, thread: str, turn: str, role: str, text: str, block: str, calls: str | None = None) -> DataFrame:
    """Turns worth remembering: a marked block is cut out; a user turn of nothing else goes, and so does the answer that follows it.
    Turns with tool calls (a column that says so) go, and are no answers."""
    if calls:
        messages = messages.where(~F.coalesce(F.col(calls), F.lit(False)))
    w = Window.partitionBy(thread).orderBy(turn)
    cut = messages.withColumn("clean", F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), block, "")))
    empty = (F.col(role) == "user") & (F.col("clean") == "") & (F.coalesce(F.col(text), F.lit("")) != "")
    return cut.withColumn("__e", empty).withColumn("__p", F.coalesce(F.lag("__e").over(w), F.lit(False))).where(~F.col("__e") & ~(F.col("__p") & (F.col(role) == "assistant"))).drop("__e", "__p")


def list_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """What changed between two lists (pos, content, status): by content, then what is left by place: start, complete, update, remove."""
    number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("content").orderBy("pos")))
    a, b = number(previous), number(following)
    same = a.alias("a").join(b.alias("b"), ["content", "k"]).select(F.col("a.pos").alias("old_pos"), F.col("b.pos").alias("pos"), "content", F.col("a.status").alias("was"), F.col("b.status").alias("now"))
    old = a.join(same.select(F.col("old_pos").alias("pos")), "pos", "left_anti").select("pos", F.col("content").alias("old"), F.col("status").alias("was"))
    new = b.join(same.select("pos"), "pos", "left_anti").select("pos", "content", F.col("status").alias("now"))
    rest = old.join(new, "pos", "full")
    every = same.select("pos", "content", "was", "now").unionByName(rest.select("pos", F.coalesce("content", "old").alias("content"), F.when(F.col("old").isNotNull(), F.col("was")).alias("was"), "now"))
    action = F.when(F.col("now").isNull(), "remove").when((F.col("now") == "in_progress") & ~F.col("was").eqNullSafe(F.lit("in_progress")), "start").when((F.col("now") == "completed") & ~F.col("was").eqNullSafe(F.lit("completed")), "complete").when(~F.col("was").eqNullSafe(F.col("now")), "update")
    return every.withColumn("action", action).where("action IS NOT NULL")
