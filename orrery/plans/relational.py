"""Relational queries: summaries, joins, windows, sets and stores over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import values
from orrery.operators import aggregate, graph, store, windows
from orrery.plans.registry import query, table
from orrery.sources import catalog
from orrery.sources.stored import StoredTable


def money(c: Column | str) -> Column:
    """An exact sum of amounts, so that the order of adding makes no difference."""
    return F.sum(F.col(c).cast("decimal(18,4)") if isinstance(c, str) else c.cast("decimal(18,4)")).cast("double")


@query("trends_by_day_type", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def trends_by_day_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), money("value").alias("total"))


@query(
    "trends_grouping_sets",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(GROUPING(CAST(CAST(ts AS DATE) AS VARCHAR), event_type) AS BIGINT) AS set_id, count(*) AS n
       FROM events GROUP BY GROUPING SETS ((CAST(CAST(ts AS DATE) AS VARCHAR), event_type), (event_type), ())""",
)
def trends_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.trends(table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type"), ("day", "event_type"), ("event_type",))


@query("day_range_filter", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events WHERE CAST(CAST(ts AS DATE) AS VARCHAR) BETWEEN '2024-01-05' AND '2024-01-20' AND event_type = 'purchase'")
def day_range_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    return aggregate.between_days(e, "day", "2024-01-05", "2024-01-20", event_type="purchase")


@query("record_query_top", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_all FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def record_query_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.orderBy(F.desc("ts"), "event_id").limit(50).join(F.broadcast(e.agg(F.count("*").alias("n_all")))).select("event_id", "event_type", "n_all")


@query("cross_table_join_revenue", "SELECT c_mktsegment, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def cross_table_join_revenue(spark: SparkSession, d: str) -> DataFrame:
    # one row an order before the join, so customers meet orders and not lines
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("r"))
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.sum("r").cast("double").alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


@query("monthly_revenue", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY 1")
def monthly_revenue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(money("o_totalprice").alias("total"), F.count("*").alias("n"))


@query(
    "running_total_rank",
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS t FROM orders GROUP BY 1)
       SELECT month, CAST(sum(t) OVER (ORDER BY month) AS DOUBLE) AS running, rank() OVER (ORDER BY t DESC) AS rnk FROM m""",
)
def running_total_rank(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("t"))
    return m.select("month", F.sum("t").over(Window.orderBy("month")).cast("double").alias("running"), F.rank().over(Window.orderBy(F.desc("t"))).alias("rnk"))


@query("window_pass_through", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following, ntile(4) OVER w AS quarter, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_pass_through(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("following"), F.ntile(4).over(w).alias("quarter"), F.first("o_orderkey").over(w).alias("first_key"))


@query("pivot_case", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o FROM lineitem GROUP BY 1")
def pivot_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("n_f"), F.count_if(F.col("l_linestatus") == "O").alias("n_o"))


@query("top_customers", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(money("o_totalprice").alias("total")).orderBy(F.desc("total"), "o_custkey").limit(100)


@query("offset_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)


@query("union_sources", "SELECT 'events' AS __db, event_id AS id, CAST(ts AS DATE) AS day FROM events UNION ALL SELECT 'orders', o_orderkey, CAST(o_orderdate AS DATE) FROM orders")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    return catalog.federate({"events": table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day")), "orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))})


@query("union_missing_columns", "SELECT 'customer' AS __db, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.federate({"customer": table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("name"))}, ["name", "segment"])


@query("anti_join_unlabeled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabeled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_join_labeled", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_labeled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("grouping_sets_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_sets_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("intersect_except", "SELECT * FROM ((SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return both.exceptAll(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


_NUMERIC = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS \"min\", quantile_cont({c}, 0.25) AS q25, CAST(median({c}) AS DOUBLE) AS median, quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS \"max\" FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query("numeric_summary_lineitem", _NUMERIC)
def numeric_summary_lineitem(spark: SparkSession, d: str) -> DataFrame:
    s = aggregate.numeric_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("categorical_summary_part", "SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS percent, (SELECT count(DISTINCT p_brand) FROM part) AS n_distinct, CAST(0 AS BIGINT) AS nulls FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 5")
def categorical_summary_part(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.categorical_summary(table(spark, d, "part"), "p_brand")


@query("non_null_counts", "SELECT unnest(['event_id','ts','user_id','event_type','value','props']) AS \"column\", unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS non_null, count(*) AS n_rows FROM events")
def non_null_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.non_null_counts(table(spark, d, "events"))


@query("top_groups", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS n_met FROM events GROUP BY 1 ORDER BY n_met DESC, total DESC, user_id LIMIT 20")
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.top_groups(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", 20)


@query("keyword_heat", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def keyword_heat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("entity_topk", "SELECT bucket, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT 'k' AS bucket, trim(json_extract_string(props, '$.k')) AS value, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 5")
def entity_topk(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.entity_top(table(spark, d, "events"), "props", ["k", "absent"], 5)


@query("insert_or_ignore_day_id", "SELECT CAST(ts AS DATE) AS day, user_id, min(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 AND (CAST(ts AS DATE), user_id) NOT IN (SELECT (CAST(ts AS DATE), user_id) FROM events WHERE event_id % 3 = 0) GROUP BY 1, 2")
def insert_or_ignore_day_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", "event_id")
    return store.new_rows(e.where("event_id % 3 != 0"), e.where("event_id % 3 = 0"), ["day", "user_id"], [F.col("event_id")])


@query("best_of_dedupe", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def best_of_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.best_of(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", [F.desc_nulls_last("value"), F.col("event_id")])


@query("first_wins_dedupe", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    # texts are told by digest before the shuffle
    keyed = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


_UPSERT = "SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal, coalesce(a.c_name, b.c_name) AS c_name FROM customer a FULL JOIN (SELECT CASE WHEN c_acctbal < 0 THEN c_custkey ELSE -c_custkey END AS c_custkey, c_acctbal + 1 AS c_acctbal, c_name FROM customer) b ON a.c_custkey = b.c_custkey"


def _upsert_batch(c: DataFrame) -> DataFrame:
    # all customers are stored; the batch has each again with another balance, under its key if in debt and else under a new one
    return c.select(F.when(F.col("c_acctbal") < 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_name")


@query("upsert_merge", _UPSERT)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    return store.upsert(c, _upsert_batch(c), "c_custkey", ["c_acctbal"])


@query("stored_upsert", _UPSERT)
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    graph.ensure_checkpoints(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")
    stored = StoredTable.create(c, f"{spark.sparkContext.getCheckpointDir()}/customers-{uuid.uuid4().hex}", "c_custkey", n_buckets=8)
    return stored.upsert(_upsert_batch(c), ["c_acctbal"]).read()


@query("crosstab_probe", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"n_1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"n_5-LOW\", count(*) AS total FROM orders GROUP BY 1")
def crosstab_probe(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("crosstab_strata", "SELECT year(o_orderdate) AS stratum, o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"n_1-URGENT\", count(*) AS total FROM orders GROUP BY GROUPING SETS ((1, 2), (2))")
def crosstab_strata(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.crosstab(table(spark, d, "orders").withColumn("stratum", F.year("o_orderdate").cast("long")), "o_orderstatus", "o_orderpriority", ["1-URGENT"], "stratum")


@query("bench_stats_delta", "WITH s AS (SELECT l_linestatus AS config, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1) SELECT a.config, a.mean, round(a.mean - b.mean, 4) AS delta FROM s a, s b WHERE b.config = (SELECT min(config) FROM s)")
def bench_stats_delta(spark: SparkSession, d: str) -> DataFrame:
    s = aggregate.bench_stats(table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "config"), "config", "l_quantity").select("config", "mean")
    first = s.agg(F.min_by("mean", "config").alias("base"))
    return s.join(F.broadcast(first)).select("config", "mean", F.round(F.col("mean") - F.col("base"), 4).alias("delta"))


_STRATUM = "CASE WHEN c_acctbal < 0 THEN 'L1' WHEN c_acctbal < 5000 THEN 'L2' ELSE 'L3' END"


@query("stratified_quota", f"SELECT c_custkey, stratum FROM (SELECT c_custkey, {_STRATUM} AS stratum, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':7'), c_custkey) AS r FROM customer) WHERE r <= CASE stratum WHEN 'L3' THEN 11 ELSE 10 END")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    stratum = F.when(b < 0, "L1").when(b < 5000, "L2").otherwise("L3")
    return windows.stratified(table(spark, d, "customer"), "c_custkey", stratum, 31, ["L1", "L2", "L3"], ["L3", "L2", "L1"], 7).select("c_custkey", "stratum")


@query("budget_prefix", "SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, sum(1 + event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events) WHERE spent <= 20")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cost", 1 + F.col("event_id") % 7)
    return windows.budget_prefix(e, ["user_id"], [F.desc("event_id")], "cost", 20).select("user_id", "event_id", "spent")


@query("max_facts_topk", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def max_facts_topk(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("batch_chunks", "SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS INTEGER) AS chunk FROM orders")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows.chunks(table(spark, d, "orders").select("o_custkey", "o_orderkey"), [F.col("o_orderkey")], 3, ["o_custkey"])


@query("confidence_ladder", "SELECT o_orderkey, CASE least(CASE WHEN o_totalprice > 200000 THEN 1 WHEN o_totalprice > 100000 THEN 2 ELSE 3 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, 3) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level FROM orders")
def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    level = F.when(p > 200000, "high").when(p > 100000, "medium").otherwise("low")
    return table(spark, d, "orders").select("o_orderkey", values.ladder(level, (F.col("o_orderstatus") == "P").cast("int")).alias("level"))


@query("re_review_predicate", "SELECT event_id FROM events WHERE value IS NULL OR event_id % 50 > (event_id % 10) * 2 OR ts < TIMESTAMP '2024-03-01' - INTERVAL 30 DAY")
def re_review_predicate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    due = values.needs_review(F.col("event_id") % 50, F.col("event_id") % 10, F.when(F.col("value").isNotNull(), F.col("ts")), F.lit("2024-03-01").cast("timestamp_ntz"))
    return e.where(due).select("event_id")


@query("query_strings", "SELECT r_name || ' ' || n_name AS q FROM region, nation ORDER BY r_name, n_name LIMIT 40")
def query_strings(spark: SparkSession, d: str) -> DataFrame:
    # both lists are configuration of a few rows
    return table(spark, d, "region").crossJoin(F.broadcast(table(spark, d, "nation"))).select(F.concat_ws(" ", "r_name", "n_name").alias("q"), "r_name", "n_name").orderBy("r_name", "n_name").limit(40).select("q")


@query("active_conflicts", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def active_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.join(o.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "left_semi").select("o_orderkey")


@query("cluster_sample_topk", "WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1 ORDER BY size DESC, o_custkey LIMIT 10) SELECT o_custkey, o_orderkey FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders o JOIN s USING (o_custkey)) WHERE r <= 5")
def cluster_sample_topk(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("ord", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return graph.sample_clusters(o, "o_custkey", F.col("ord"), 10, 5).select("o_custkey", "o_orderkey")


@query("risk_level_buckets", "SELECT CASE WHEN 2 * p_size >= 70 THEN 'high' WHEN 2 * p_size >= 40 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS percent FROM part GROUP BY 1")
def risk_level_buckets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    counts = p.groupBy(values.risk_level(2 * F.col("p_size")).alias("level")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(p.agg(F.count("*").alias("t")))).select("level", "n", values.percentage(F.col("n"), F.col("t")).alias("percent"))


@query("guarded_select", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def guarded_select(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("guarded_events")
    return catalog.select(spark, "WITH x AS (SELECT event_type, count(*) AS n FROM guarded_events GROUP BY event_type) SELECT * FROM x ORDER BY n DESC, event_type", 3).rows
