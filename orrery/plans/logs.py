"""Event-log, conversation and streaming-twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import values
from orrery.operators import aggregate, store, windows
from orrery.plans.registry import query, table
from orrery.streaming import operators


def _sequenced(spark: SparkSession, d: str) -> DataFrame:
    return store.assign_sequence(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")])


_SEQ = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@query("seq_assign", f"SELECT user_id, event_id, CAST(seq AS INTEGER) AS seq FROM {_SEQ}")
def seq_assign(spark: SparkSession, d: str) -> DataFrame:
    return _sequenced(spark, d).select("user_id", "event_id", "seq")


@query("keyset_latest", f"SELECT event_id, CAST(seq AS INTEGER) AS seq FROM {_SEQ} WHERE user_id = 7 ORDER BY seq DESC LIMIT 5")
def keyset_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.page(_sequenced(spark, d).where("user_id = 7"), limit=5).select("event_id", "seq")


@query("keyset_before", f"SELECT event_id, CAST(seq AS INTEGER) AS seq FROM {_SEQ} WHERE user_id = 7 AND seq < 6 ORDER BY seq DESC LIMIT 3")
def keyset_before(spark: SparkSession, d: str) -> DataFrame:
    return store.page(_sequenced(spark, d).where("user_id = 7"), limit=3, before=6).select("event_id", "seq")


@query("keyset_after", f"SELECT event_id, CAST(seq AS INTEGER) AS seq FROM {_SEQ} WHERE user_id = 7 AND seq > 2 ORDER BY seq LIMIT 3")
def keyset_after(spark: SparkSession, d: str) -> DataFrame:
    return store.page(_sequenced(spark, d).where("user_id = 7"), limit=3, after=2).select("event_id", "seq")


@query("last_per_group_join", "SELECT c.conv_id, c.turn, l.quality FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'assistant') c LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE r = 1")
def last_per_group_join(spark: SparkSession, d: str) -> DataFrame:
    last = store.last_per_group(table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")])
    return last.join(table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), "quality"), "conv_id", "left")


@query("token_rollup", "SELECT model, CAST(sum(l_linenumber) AS BIGINT) AS tokens, count(*) AS runs FROM (SELECT coalesce(nullif(l_returnflag, 'N'), 'unknown') AS model, * FROM lineitem WHERE l_linestatus = 'F' OR l_linestatus = 'O') GROUP BY ROLLUP (model)")
def token_rollup(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("model_name"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("total_tokens"))
    return aggregate.roll_up_tokens(runs, ["F", "O"])


@query("cond_counts", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative FROM labels")
def cond_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"))


@query("json_typed_match", "SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 42")
def json_typed_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(values.json_matches(F.col("props"), "k", 42)).select("event_id")


@query("distinct_usage", "SELECT CASE WHEN event_type = 'error' THEN 'lead' ELSE 'subagent' END AS caller, CAST(sum(user_id) AS BIGINT) AS tokens FROM events GROUP BY 1")
def distinct_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    usage = e.unionByName(e).select(F.col("event_id").alias("source_run_id"), F.when(F.col("event_type") == "error", "agent").otherwise(F.concat(F.lit("subagent:"), "event_type")).alias("caller"), F.lit(0).cast("bigint").alias("total_tokens"), F.col("user_id").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"))
    return aggregate.distinct_usage(usage)


@query("repeat_window", f"WITH q AS {_SEQ} SELECT a.user_id, a.event_id, CAST(count(*) AS INTEGER) AS repeats FROM q a JOIN q b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.seq BETWEEN a.seq - 19 AND a.seq GROUP BY ALL")
def repeat_window(spark: SparkSession, d: str) -> DataFrame:
    return windows.repetitions(_sequenced(spark, d), "user_id", "seq", "event_type").select("user_id", "event_id", "repeats")


@query("running_tool_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS uses FROM events")
def running_tool_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_counts(_sequenced(spark, d), "user_id", "event_type", "seq").select("event_id", "uses")


@query("latency_lag", "SELECT event_id, date_sub('second', lag(ts) OVER w, ts) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def latency_lag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).alias("seconds"))


@query("call_groups", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS call_group FROM conversations")
def call_groups(spark: SparkSession, d: str) -> DataFrame:
    return windows.call_groups(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "call_group")


@query("correction_last6", "SELECT conv_id, coalesce(bool_or(role = 'user' AND regexp_matches(text, '(?i)thing')), false) AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY 1")
def correction_last6(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_flags(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", "(?i)thing")


@query("upload_skip_filter", "SELECT conv_id, turn FROM (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT *, role = 'user' AND trim(regexp_replace(coalesce(text, ''), '^[A-Z][^.]{0,60}\\.$', '')) = '' AND coalesce(text, '') <> '' AS e FROM conversations WHERE NOT (role = 'assistant' AND contains(coalesce(text, ''), 'thing')))) WHERE NOT e AND NOT (coalesce(p, false) AND role = 'assistant')")
def upload_skip_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("calls", (F.col("role") == "assistant") & F.col("text").contains("thing"))
    return windows.memory_messages(c, "conv_id", "turn", "role", "text", r"^[A-Z][^.]{0,60}\.$", "calls").select("conv_id", "turn")


@query("nested_comments", "SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def nested_comments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("note_id"), F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))).alias("parent_comment_id"), F.col("turn").alias("create_time"), F.col("text").alias("content"), F.col("role").alias("user_id"))
    nested = store.nest_comments(c.select("note_id").distinct(), c, "note_id")
    own = F.aggregate("comments", F.lit(0).cast("bigint"), lambda s, t: s + F.when(t["content"] == "[deleted]", 0).otherwise(F.when(t["at"] == 0, 1).otherwise(0)) + F.size(t["replies"]))
    chars = F.aggregate("comments", F.lit(0).cast("bigint"), lambda s, t: s + F.when(t["content"] == "[deleted]", 0).otherwise(F.length(t["content"])) + F.aggregate(t["replies"], F.lit(0), lambda a, r: a + F.length(r["content"])))
    return nested.select(F.col("note_id").alias("conv_id"), own.alias("n_turns"), chars.alias("chars"))


@query("involved_set", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS involved FROM conversations GROUP BY 1")
def involved_set(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") == 0, F.col("role"))).alias("authors"), F.collect_list(F.when(F.col("turn") > 0, F.col("role"))).alias("commenters"))
    return aggregate.involved(posts, F.col("authors"), F.col("commenters")).select("conv_id", F.array_join("involved", ",").alias("involved"))


@query("session_debounce_batch", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def session_debounce_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"t": F.col("ts").cast("timestamp"), "late": F.lit(False)})
    return operators.debounce(e, ["user_id"], "t", "event_id", ["late"], "6 hours").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("daily_quota_batch", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2")
def daily_quota_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return operators.daily_quota(e, "user_id", "t", 2).select("user_id", F.to_date("window.start").alias("day"), "n", "over")


@query("replay_last", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 256")
def replay_last(spark: SparkSession, d: str) -> DataFrame:
    return operators.replay(table(spark, d, "events"), 7, None, run_column="user_id").select("event_id")
