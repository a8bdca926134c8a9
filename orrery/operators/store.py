"""Idempotent stores, event logs and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.text import truncate_utf8


def raw_identity(payload: Column) -> Column:
    """The identity of a raw message in JSON: by msg_id, else by tweet_id, else null."""
    take = lambda k: F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    return F.coalesce(F.concat(F.lit("msg_id:"), take("msg_id")), F.concat(F.lit("tweet_id:"), take("tweet_id")))


def new_rows(batch: DataFrame, stored: DataFrame | None, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's rows that aren't stored yet, the first of each key by an order; rows with a null in a key are always new."""
    whole = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    once = whole.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
    if stored is not None:
        once = once.join(stored.select(*keys), keys, "left_anti").select(*batch.columns)
    return once.unionByName(batch.where(" OR ".join(f"`{k}` IS NULL" for k in keys)))


def insert_or_ignore(batch: DataFrame, path: str, keys: list[str], order: list[Column], partition: str = "day") -> int:
    """Append the rows that a day-partitioned table doesn't hold yet; returns their number. Only the batch's days are read."""
    spark = batch.sparkSession
    stored = None
    if exists(spark, path):
        days = [r[0] for r in batch.select(partition).distinct().collect()]
        stored = spark.read.parquet(path).where(F.col(partition).isin(days))
    fresh = new_rows(batch, stored, keys, order).persist()
    try:
        n = fresh.count()
        fresh.write.mode("append").partitionBy(partition).parquet(path)
        return n
    finally:
        fresh.unpersist()


def append_raw(batch: DataFrame, path: str, payload: str = "payload", day: str = "day") -> int:
    """Append raw messages (JSON) to an archive by day, each identity once a day; those without an identity are always kept."""
    keyed = batch.withColumn("identity", raw_identity(F.col(payload)))
    return insert_or_ignore(keyed, path, [day, "identity"], [F.col(payload)], day)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert(stored: DataFrame, batch: DataFrame, key: str, volatile: list[str]) -> DataFrame:
    """Stored rows with the volatile columns of the batch where keys meet, and the batch's new rows."""
    a, b = stored.alias("a"), batch.alias("b")
    columns = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in volatile else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in stored.columns if c != key]
    return a.join(b, key, "full").select(key, *columns)


def assign_sequence(events: DataFrame, thread: str, order: list[Column], last: DataFrame | None = None) -> DataFrame:
    """Adds seq: 1, 2, … in each thread, after the thread's last stored one (columns thread and seq)."""
    seq = F.row_number().over(Window.partitionBy(thread).orderBy(*order))
    if last is None:
        return events.withColumn("seq", seq)
    base = last.groupBy(thread).agg(F.max("seq").alias("__base"))
    return events.withColumn("seq", seq).join(base, thread, "left").withColumn("seq", F.col("seq") + F.coalesce("__base", F.lit(0))).drop("__base")


def append_events(batch: DataFrame, last: DataFrame | None, order: list[Column], max_trace: int = 10_240) -> DataFrame:
    """A batch of one thread's events (thread_id, category, content, metadata as a map) as they are stored: with seq after the thread's
    last one, and traces of more than `max_trace` bytes cut to whole characters, which metadata tells.

    ValueError names the threads of a batch that has several.
    """
    threads = [r[0] for r in batch.select("thread_id").distinct().limit(3).collect()]
    if len(threads) > 1:
        raise ValueError(f"events of several threads: {threads}")
    size = F.octet_length("content")
    long = (F.coalesce(F.col("category"), F.lit("trace")) == "trace") & (size > max_trace)
    told = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("content_truncated"), F.lit("true"), F.lit("original_byte_length"), size.cast("string")))
    cut = batch.withColumns({"metadata": F.when(long, told).otherwise(F.col("metadata")), "content": F.when(long, truncate_utf8(F.col("content"), max_trace)).otherwise(F.col("content"))})
    return assign_sequence(cut, "thread_id", order, last)


def migrate_table(old: DataFrame, stored: DataFrame | None, keys: list[str], order: list[Column], renamed: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """The rows of a table of an earlier layout that the present one lacks, under the present names: to be appended, after which the old
    table can go."""
    return new_rows(old.withColumnsRenamed(renamed), stored, keys, order)


def page(events: DataFrame, seq: str = "seq", limit: int = 50, before: int | None = None, after: int | None = None) -> DataFrame:
    """A page in ascending order: the first rows above `after`, else the last below `before`, else the last; both bounds hold."""
    if before is not None:
        events = events.where(F.col(seq) < before)
    if after is not None:
        return events.where(F.col(seq) > after).orderBy(seq).limit(limit)
    return events.orderBy(F.desc(seq)).limit(limit).orderBy(seq)


def last_per_group(events: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return events.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def keep_last_visible(messages: DataFrame, identity: str, visible: str, index: str) -> DataFrame:
    """The last visible message of each identity, else its last; messages without one stay."""
    kept = last_per_group(messages.where(F.col(identity).isNotNull()), [identity], [F.desc(visible), F.desc(index)])
    return kept.unionByName(messages.where(F.col(identity).isNull()))


def nest_comments(posts: DataFrame, comments: DataFrame, post: str = "note_id") -> DataFrame:
    """Posts with their comments as an ordered array of threads: top comment and replies; a reply whose parent is missing opens a
    thread under a placeholder. Two levels, as in the source."""
    is_top = F.coalesce(F.col("parent_comment_id"), F.lit("")).isin("", "0")
    one = F.struct("create_time", "comment_id", "content", "user_id")
    tops = comments.where(is_top).select(post, F.col("comment_id").alias("thread"), one.alias("top"))
    replies = comments.where(~is_top).groupBy(post, F.col("parent_comment_id").alias("thread")).agg(F.sort_array(F.collect_list(one)).alias("replies"))
    threads = tops.join(replies, [post, "thread"], "full").select(post, F.struct(F.coalesce("top.create_time", F.col("replies")[0]["create_time"]).alias("at"), "thread", F.coalesce("top.content", F.lit("[deleted]")).alias("content"), F.coalesce("replies", F.array().cast(replies.schema["replies"].dataType)).alias("replies")).alias("t"))
    return posts.join(threads.groupBy(post).agg(F.sort_array(F.collect_list("t")).alias("comments")), post, "left")


def zip_verdicts(messages: DataFrame, verdicts: DataFrame, batch: str, index: str) -> tuple[DataFrame, DataFrame]:
    """Messages joined with verdicts on their place in the batch; and those without one, with a reason, for the dead-letter sink."""
    joined = messages.join(verdicts, [batch, index], "left_anti").withColumn("reason", F.lit("no verdict"))
    return messages.join(verdicts, [batch, index]), joined
