"""Queries of the search and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text, values
from orrery.operators import aggregate, graph, reports, search, store
from orrery.plans.registry import query, table


def _threads(spark: SparkSession, d: str) -> DataFrame:
    """Events as threads: owner, state, metadata and time of change."""
    return table(spark, d, "events").select(F.col("event_id").alias("thread_id"), "user_id", F.col("event_type").alias("status"), F.col("props").alias("metadata"), F.col("ts").alias("updated_at"))


@query("search_threads", "SELECT event_id AS thread_id, user_id FROM events WHERE event_type = 'purchase' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 42 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 1")
def search_threads(spark: SparkSession, d: str) -> DataFrame:
    return search.search_threads(_threads(spark, d), status="purchase", metadata={"k": 42}, limit=20, offset=1).select("thread_id", "user_id")


@query("search_own_threads", "SELECT event_id AS thread_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def search_own_threads(spark: SparkSession, d: str) -> DataFrame:
    return search.search_threads(_threads(spark, d), user=7).select("thread_id")


def _access(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    threads = table(spark, d, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("thread_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("user_id"))
    requests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("user_id"), "l_linenumber")
    return search.check_access(requests, threads, strict)


_ACCESS = "SELECT l_orderkey AS thread_id, l_suppkey AS user_id, l_linenumber, CASE WHEN o_orderkey IS NULL THEN {} ELSE o_orderstatus = 'P' OR coalesce(o_custkey = l_suppkey, false) END AS allowed FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey"


@query("check_access", _ACCESS.format("true"))
def check_access(spark: SparkSession, d: str) -> DataFrame:
    return _access(spark, d, False)


@query("check_access_strict", _ACCESS.format("false"))
def check_access_strict(spark: SparkSession, d: str) -> DataFrame:
    return _access(spark, d, True)


@query("in_flight_runs", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= DATE '1996-06-30' ORDER BY o_orderdate")
def in_flight_runs(spark: SparkSession, d: str) -> DataFrame:
    return search.in_states(table(spark, d, "orders"), ["O", "P"], F.to_date(F.lit("1996-06-30")), "o_orderdate", "o_orderstatus").select("o_orderkey", "o_orderdate")


@query("run_events", "SELECT event_id, CAST(seq AS INTEGER) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE user_id = 7 AND event_type IN ('click', 'purchase') ORDER BY seq LIMIT 500")
def run_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"thread_id": F.col("user_id"), "run_id": F.lit(1)})
    return search.run_events(store.assign_sequence(e, "thread_id", [F.col("ts"), F.col("event_id")]), 7, 1, ["click", "purchase"]).select("event_id", "seq")


@query("recent_runs", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return search.recent(table(spark, d, "events"), "ts", "event_id").select("event_id")


@query("oldest_feedback", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def oldest_feedback(spark: SparkSession, d: str) -> DataFrame:
    return search.recent(table(spark, d, "events").where("event_type = 'error'"), "ts", "event_id", newest=False).select("event_id")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.col("p_partkey").alias("position"))


_CATALOGUE = "(SELECT p_name AS name, p_type || ' ' || p_brand AS description, p_partkey AS position FROM part)"


@query("catalogue_select", f"WITH c AS {_CATALOGUE} SELECT position FROM c WHERE name IN (SELECT name FROM c ORDER BY position LIMIT 1) ORDER BY position LIMIT 5")
def catalogue_select(spark: SparkSession, d: str) -> DataFrame:
    c = _catalogue(spark, d)
    first = c.orderBy("position").first()  # one name, as a user would ask for it
    return search.search_catalogue(c, f"select:{first['name'] if first else ''} , nothing").select("position")


@query("catalogue_required", f"SELECT position FROM {_CATALOGUE} WHERE contains(lower(name), 'a') ORDER BY len(regexp_extract_all(name || ' ' || description, '(?i)e')) DESC, position LIMIT 5")
def catalogue_required(spark: SparkSession, d: str) -> DataFrame:
    return search.search_catalogue(_catalogue(spark, d), "+A e").select("position")


@query("catalogue_pattern", f"SELECT position FROM {_CATALOGUE} WHERE regexp_matches(name || ' ' || description, '(?i)brand.?1|e') ORDER BY regexp_matches(name, '(?i)brand.?1|e') DESC, position LIMIT 5")
def catalogue_pattern(spark: SparkSession, d: str) -> DataFrame:
    return search.search_catalogue(_catalogue(spark, d), " BRAND.?1|e ").select("position")


@query("verdict_ingestion", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_orderkey % 2 WHEN 3 THEN (l_orderkey + 1) % 2 ELSE 1 END::INTEGER AS verdict FROM lineitem")
def verdict_ingestion(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    reply = F.concat(F.lit("1: 0\nno verdict\n1 :"), (F.col("l_orderkey") % 2).cast("string"), F.lit("\n3："), ((F.col("l_orderkey") + 1) % 2).cast("string"), F.lit("\n4: 7"))
    told = search.verdicts(lines.select("l_orderkey").distinct().withColumn("reply", reply), "l_orderkey", "reply")
    return search.apply_verdicts(lines, told.withColumnRenamed("index", "l_linenumber"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "verdict")


@query("risk_threshold", "SELECT p_partkey FROM part WHERE p_size > 20")
def risk_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.above_risk(table(spark, d, "part"), "p_size", 20).select("p_partkey")


@query("cluster_level_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 45)")
def cluster_level_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.groups_above(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 45).select("l_orderkey", "l_linenumber")


@query("confidence_gate", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    level = F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low")
    return search.confident(table(spark, d, "orders").withColumn("level", level), "level", "medium").select("o_orderkey")


@query("dashboard_filter", "SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'thing') AND lang = 'en'")
def dashboard_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("excerpt"), F.lit(None).cast("string").alias("author"), F.array().cast("array<string>").alias("jargon"), F.create_map("lang", F.lit(1)).alias("categories"), F.col("n_chars").alias("risk"))
    return search.browse_records(r, "THING", "en").select("doc_id")


@query("report_filter", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'thing') OR contains(lower(source), 'thing')) AND lang = 'en'")
def report_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").withColumn("group", F.col("source"))
    return search.filter_records(r, " Thing ", lang="en", source="").select("doc_id")


@query("live_cache_entries", "SELECT event_id FROM events WHERE (value IS NULL OR ts > TIMESTAMP '2024-01-15 00:00:00') AND event_type LIKE 'p%e'")
def live_cache_entries(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "events").select(F.col("event_type").alias("key"), "event_id", F.when(F.col("value").isNotNull(), F.col("ts")).alias("expires_at"))
    return search.live_entries(cache, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "p*e").select("event_id")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates, their lines' suppliers as the groups that named them."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("msg_id"), F.col("l_suppkey").alias("group")))).alias("sources"), F.count("*").alias("count"))
    return lines


def _reputation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return s.select(F.col("s_suppkey").alias("group"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("high"), F.lit(1).alias("medium"), F.lit(2).alias("total"))


_REPUTATION = "(SELECT s_suppkey AS \"group\", CAST(floor(s_acctbal / 1000) AS BIGINT) AS high FROM supplier WHERE s_acctbal > 0)"


@query("sources_with_reputation", f"SELECT l_orderkey AS key, l_suppkey AS \"group\", coalesce(high, 0) AS high, CASE WHEN high IS NULL THEN 0 ELSE 1 END::BIGINT AS medium, CASE WHEN high IS NULL THEN 0 ELSE 2 END::BIGINT AS total FROM lineitem LEFT JOIN {_REPUTATION} r ON r.\"group\" = l_suppkey")
def sources_with_reputation(spark: SparkSession, d: str) -> DataFrame:
    return search.with_reputation(_candidates(spark, d), _reputation(spark, d))


@query("sources_with_raw_text", "SELECT key, CAST(r - 1 AS INTEGER) AS position, \"group\", msg_id, CASE WHEN p_size > 25 THEN p_name END AS text FROM (SELECT l_orderkey AS key, l_suppkey AS \"group\", CAST(l_linenumber AS BIGINT) AS msg_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS r FROM lineitem) LEFT JOIN part ON p_partkey = (key * 7 + msg_id) % (SELECT count(*) FROM part) WHERE r <= 3")
def sources_with_raw_text(spark: SparkSession, d: str) -> DataFrame:
    # a stored message for some of the lines: its text is the name of a large part that the line's number leads to
    part = table(spark, d, "part")
    n = part.agg(F.count("*").alias("n_parts"))
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_linenumber").cast("long").alias("msg_id"), F.col("l_orderkey").alias("key")).crossJoin(F.broadcast(n))
    raw = lines.distinct().withColumn("p_partkey", (F.col("key") * 7 + F.col("msg_id")) % F.col("n_parts")).join(part.where("p_size > 25").select("p_partkey", F.col("p_name").alias("text")), "p_partkey")
    # group and message tell a message together with its order here
    own = F.concat_ws("-", "group", "key")
    candidates = _candidates(spark, d).withColumn("sources", F.transform("sources", lambda s: F.struct(F.concat_ws("-", s["group"], "key").alias("group"), s["msg_id"].alias("msg_id"))))
    found = search.with_raw_text(candidates, raw.select(own.alias("group"), "msg_id", "text"))
    return found.withColumn("group", F.substring_index("group", "-", 1).cast("long"))


@query("score_topk", f"SELECT key, CAST(n * greatest(coalesce(h, 0), 1) AS BIGINT) AS score FROM (SELECT l_orderkey AS key, count(*) AS n, max(high) AS h FROM lineitem LEFT JOIN {_REPUTATION} r ON r.\"group\" = l_suppkey GROUP BY 1) ORDER BY score DESC, key LIMIT 25")
def score_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.best_candidates(_candidates(spark, d), _reputation(spark, d), 25).select("key", "score")


@query("overview_counters", "SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM (SELECT 'category' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'platform', source, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'ip', left(text, 1), count(*) FROM documents WHERE left(text, 1) <> '' GROUP BY 2 UNION ALL SELECT 'risk', CASE WHEN n_chars >= 70 THEN 'high' WHEN n_chars >= 40 THEN 'medium' ELSE 'low' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'day', '2024-01-0' || (n_chars % 7), count(*) FROM documents GROUP BY 2)) WHERE kind <> 'ip' OR r <= 10")
def overview_counters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    r = docs.select(F.create_map("lang", F.lit(1)).alias("categories"), F.array("source").alias("platforms"), F.left("text", F.lit(1)).alias("ip"), F.lit("").alias("keyword"), F.col("n_chars").alias("risk"), F.concat(F.lit("2024-01-0"), (F.col("n_chars") % 7).cast("string"), F.lit(" 10:00")).alias("time"))
    return reports.overview(r)


@query("report_groups", "SELECT coalesce(nullif(l_linestatus, 'O'), 'unknown') AS platform, l_returnflag AS name, coalesce(arg_min(CASE WHEN l_linenumber > 2 THEN 'u' || l_orderkey || '-' || l_linenumber END, l_orderkey * 10 + l_linenumber) FILTER (l_linenumber > 2), '') AS group_url, count(*) FILTER (l_quantity > 40) AS high, count(*) FILTER (l_quantity > 20 AND l_quantity <= 40) AS medium, count(*) FILTER (l_quantity <= 5) AS low, count(*) AS n FROM lineitem GROUP BY 1, 2")
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    r = table(spark, d, "lineitem").select(F.nullif("l_linestatus", F.lit("O")).alias("source_platform"), F.col("l_returnflag").alias("source_group"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("u"), "l_orderkey", F.lit("-"), "l_linenumber")).otherwise("").alias("source_group_url"), F.when(q > 40, "HIGH").when(q > 20, "medium").when(q <= 5, "Low").otherwise("none").alias("risk_level"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return reports.report_groups(r, "at")


@query("report_facts", "SELECT 'keyword_heat' AS fact, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'top_groups', CAST(user_id AS VARCHAR), count(*) AS n FROM events GROUP BY 2 ORDER BY count(*) FILTER (event_type = 'error') DESC, n DESC, 2 LIMIT 20) UNION ALL SELECT 'trends', coalesce(CAST(CAST(ts AS DATE) AS VARCHAR), '') || '|' || coalesce(CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END, ''), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'trends', CAST(CAST(ts AS DATE) AS VARCHAR) || '|', count(*) FROM events GROUP BY 2 UNION ALL SELECT 'trends', '|' || CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'trends', '|', count(*) FROM events UNION ALL SELECT * FROM (SELECT 'top_entities', 'accounts=' || json_extract_string(props, '$.k'), count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 2 ORDER BY n DESC, json_extract_string(min(props), '$.k') LIMIT 20)")
def report_facts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = e.select(F.to_date("ts").cast("string").alias("day"), F.lit("p").alias("source_platform"), F.col("user_id").cast("string").alias("source_group"), F.col("event_type").alias("risk_type"), F.when(F.col("event_type") == "error", "high").otherwise("low").alias("risk_level"), F.to_json(F.struct(F.array(F.get_json_object("props", "$.k")).alias("accounts"))).alias("entities"))
    facts = reports.report_facts(r, platform="p")
    key = {
        "trends": F.concat(F.coalesce("day", F.lit("")), F.lit("|"), F.coalesce("risk_level", F.lit(""))),
        "top_groups": F.col("source_group"),
        "keyword_heat": F.col("risk_type"),
        "top_entities": F.concat_ws("=", "bucket", "value"),
    }
    out = None
    for name, df in facts.items():
        part = df.select(F.lit(name).alias("fact"), key[name].alias("key"), F.col("total" if name == "top_groups" else "n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("merge_external_terms", "WITH k AS (SELECT lang AS term, count(*) AS n, source AS s FROM documents GROUP BY 1, 3), r AS (SELECT term, sum(n)::BIGINT AS n, list(DISTINCT s) AS p FROM k GROUP BY 1), f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS term, doc_id FROM documents WHERE length(CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END) >= 2), g AS (SELECT f.term, count(*) AS m, list(DISTINCT d.lang) AS ps, list(DISTINCT d.source) AS cs FROM f JOIN documents d USING (doc_id) GROUP BY 1) SELECT coalesce(r.term, g.term) AS term, coalesce(n, 0) + coalesce(m, 0) AS n, CASE WHEN r.term IS NULL THEN 'word' ELSE 'known' END AS type, array_to_string(list_sort(list_distinct(list_concat(coalesce(p, []), coalesce(ps, [])))), ',') AS platforms, array_to_string(list_sort(coalesce(cs, [])), ',') AS categories FROM r FULL JOIN g ON g.term = r.term")
def merge_external_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    known = docs.groupBy(F.col("lang").alias("term")).agg(F.count("*").alias("n"), F.collect_set("source").alias("platforms")).withColumns({"type": F.lit("known"), "categories": F.array().cast("array<string>")})
    found = docs.select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat(F.lit(" "), "source")).alias("term"), F.when(F.col("doc_id") % 3 > 0, "word").otherwise(reports.MODEL_TERM).alias("type"), F.col("doc_id").alias("note_id"))
    records = docs.select(F.col("doc_id").alias("note_id"), F.array("lang").alias("platforms"), F.array("source").alias("categories"))
    return reports.merge_terms(known, found, records).select("term", "n", "type", F.array_join("platforms", ",").alias("platforms"), F.array_join("categories", ",").alias("categories"))


@query("seller_features", "WITH l AS (SELECT l_suppkey AS seller, p_brand AS area, p_brand AS seg, CASE WHEN p_size > 10 THEN p_type ELSE '' END AS fp, p_name AS tpl, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT seller, max(CASE WHEN k = 'a' THEN v END) AS area, max(CASE WHEN k = 'f' THEN v END) AS image_fp, max(CASE WHEN k = 't' THEN v END) AS template FROM (SELECT *, row_number() OVER (PARTITION BY seller, k ORDER BY n DESC, v) AS r FROM (SELECT seller, 'a' AS k, area AS v, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT seller, 'f', fp, count(*) FROM l WHERE fp <> '' GROUP BY ALL UNION ALL SELECT seller, 't', tpl, count(*) FROM l WHERE length(tpl) >= 6 GROUP BY ALL)) WHERE r = 1 GROUP BY 1) SELECT seller, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT seg)), 1, 8), ',') AS segments, CAST(count(DISTINCT CASE WHEN length(tpl) >= 6 THEN tpl END) AS INTEGER) AS n_templates, left(arg_min(tpl, pos), 80) AS first_title, any_value(m.area) AS area, any_value(m.image_fp) AS image_fp, any_value(m.template) AS template FROM l JOIN m USING (seller) GROUP BY 1")
def seller_features(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    listings = lines.select(F.col("l_suppkey").cast("string").alias("seller"), F.col("p_brand").alias("area"), F.array("p_brand").alias("segment"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("image_fp"), F.col("p_name").alias("template"), F.col("p_name").alias("title"), F.lit("").alias("link"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    f = reports.seller_features(listings, "at")
    return f.select(F.col("seller").cast("long").alias("seller"), "n", F.array_join("segments", ",").alias("segments"), F.size("templates").alias("n_templates"), "first_title", "area", "image_fp", "template")


@query("super_groups", "SELECT n_regionkey, count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS members, array_to_string(list_slice(list(n_name ORDER BY n_nationkey), 1, 8), ',') AS names FROM nation JOIN (SELECT c_nationkey, count(*) AS size FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def super_groups(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("size"))
    members = table(spark, d, "nation").join(sizes, "n_nationkey")
    return reports.super_groups(members, "n_nationkey", "n_regionkey", "n_name", "size").withColumn("names", F.array_join("names", ","))


@query("kpi_funnel", "WITH s AS (SELECT 1 AS position, 'all' AS stage, count(*) AS n FROM documents UNION ALL SELECT 2, 'long', count(*) FROM documents WHERE n_chars > 1000 UNION ALL SELECT 3, 'long english', count(*) FROM documents WHERE n_chars > 1000 AND lang = 'en') SELECT position, stage, n, round(100.0 * n / first_value(n) OVER w, 1) AS of_first, round(100.0 * n / lag(n) OVER w, 1) AS of_before FROM s WINDOW w AS (ORDER BY position)")
def kpi_funnel(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    long = F.col("n_chars") > 1000
    counts = docs.agg(F.count("*").alias("all"), F.count_if(long).alias("long"), F.count_if(long & (F.col("lang") == "en")).alias("long english"))
    stages = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("stage"), F.col(f"`{c}`").alias("n")) for i, c in enumerate(counts.columns, 1)])).alias("s")).select("s.*")
    return reports.funnel(stages)


@query("demand_signals", "SELECT conv_id, count(*) FILTER (contains(text, 'thing') OR contains(text, 'ation'))::INTEGER AS inquiries, CAST(least(5, count(*) FILTER (contains(text, 'thing') OR contains(text, 'ation'))) AS INTEGER) AS n_samples, coalesce(sum(CASE WHEN r <= 5 THEN length(text) END), 0)::BIGINT AS sample_chars FROM (SELECT *, CASE WHEN contains(text, 'thing') OR contains(text, 'ation') THEN row_number() OVER (PARTITION BY conv_id, contains(text, 'thing') OR contains(text, 'ation') ORDER BY turn) END AS r FROM conversations) GROUP BY 1")
def demand_signals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("comments"))
    s = c.select("conv_id", reports.demand_signals(F.col("comments"), ["thing", "ation"]).alias("s"))
    chars = F.aggregate("s.samples", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"]))
    return s.select("conv_id", "s.inquiries", F.size("s.samples").alias("n_samples"), chars.alias("sample_chars"))


@query("risk_tags_of_records", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey > 50 THEN '已露出联系方式' END, CASE WHEN o_totalprice > 100000 THEN '明码标价' END, CASE WHEN o_orderstatus = 'F' THEN '反诈伪装话术' END, CASE WHEN k >= 5 THEN '高需求热度' END, CASE WHEN k >= 3 THEN '评论区导流' END, CASE WHEN o_orderstatus = 'P' THEN '高危业务类目' END, CASE WHEN k = 0 THEN '批量铺量' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT *, o_orderkey % 7 AS k FROM orders)")
def risk_tags_of_records(spark: SparkSession, d: str) -> DataFrame:
    k, status = F.col("o_orderkey") % 7, F.col("o_orderstatus")
    category = F.when(status == "P", F.array(F.lit("x"), F.lit("赌博诈骗"))).otherwise(F.array(F.lit("x")))
    tags = reports.risk_tags((F.col("o_custkey") > 50).cast("int"), (F.col("o_totalprice") > 100000).cast("int"), (status == "F").cast("int"), k, category, (k == 0).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tags, ",").alias("tags"))


@query("mined_references", "SELECT conv_id, turn, unnest(['+Hash_' || conv_id, '+Old-' || turn, 'some_channel_' || conv_id, 'forwarded']) AS key, unnest(['text', 'text', 'text', 'forward']) AS channel FROM conversations")
def mined_references(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    said = F.concat(F.lit("https://t.me/+Hash_"), c, F.lit(" http://t.me/joinchat/Old-"), t, F.lit(" https://t.me/Some_Channel_"), c, F.lit("/12, @some_CHANNEL_"), c, F.lit(" https://t.me/share @addtheme @abc @own_group a@mail_address @"), F.lit("x" * 40))
    found = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.mined_references(said, F.lit("Forwarded"), F.lit("Own_Group"))).alias("r"))
    return found.select("conv_id", "turn", "r.key", "r.channel")


@query("bot_previews", "SELECT conv_id, turn, unnest(['📌', '🎬']) AS icon, unnest(['no link ' || turn, 'https://t.me/some_channel/' || turn]) AS text, unnest([NULL, 'some_channel']) AS channel, unnest([NULL, turn])::BIGINT AS msg_id FROM conversations")
def bot_previews(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn").cast("string")
    reply = F.concat(F.lit("header\n广告: buy\n 📌 no link "), t, F.lit(" \n\n🔥\r\n🎬 https://t.me/some_channel/"), t)
    found = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.bot_previews(reply)).alias("p"))
    return found.select("conv_id", "turn", "p.icon", "p.text", "p.channel", "p.msg_id")


@query("call_hash_groups", "SELECT l_linenumber % 3 AS kind, count(DISTINCT l_orderkey // 200) AS n FROM lineitem GROUP BY 1")
def call_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    # calls that read the same bucket of 200 lines are one, whatever their order and other arguments
    args = F.to_json(F.struct(F.lit("a.txt").alias("path"), (F.col("l_orderkey") + 1).alias("start_line"), F.col("l_linenumber").alias("reason")))
    kind = F.col("l_linenumber") % 3
    read, other = F.struct(F.lit("read_file").alias("name"), args.alias("arguments")), F.struct(F.lit("search").alias("name"), F.concat(F.lit('{"note":"n","query":"q'), kind.cast("string"), F.lit('"}')).alias("arguments"))
    calls = F.when(F.col("l_linenumber") > 3, F.array(read, other)).otherwise(F.array(other, read))
    return table(spark, d, "lineitem").select(kind.alias("kind"), text.call_hash(calls).alias("h")).groupBy("kind").agg(F.count_distinct("h").alias("n"))


@query("profile_urls", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://x.com/u' || page_id ELSE '' END AS profile FROM pages")
def profile_urls(spark: SparkSession, d: str) -> DataFrame:
    k, post = F.col("page_id") % 3, F.concat(F.lit("https://x.com/u"), F.col("page_id").cast("string"), F.lit("/status/9"))
    return table(spark, d, "pages").select("page_id", text.profile_url(F.when(k == 0, F.col("url")).otherwise(""), post, F.when(k == 1, "Twitter").otherwise("telegram")).alias("profile"))


@query("listing_marks", "SELECT event_id, 'O1CN01' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS image, strftime(ts, '%Y-%m-%d %H') || 'h' AS hour FROM events")
def listing_marks(spark: SparkSession, d: str) -> DataFrame:
    image = F.concat(F.lit("https://img/O1CN01"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("abc_!!.jpg"))
    return table(spark, d, "events").select("event_id", text.image_fingerprint(image).alias("image"), text.hour_bucket(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("hour"))


@query("token_usage_by_caller", "SELECT CASE WHEN event_type = 'error' THEN 'lead' WHEN event_type = 'click' THEN 'middleware' ELSE 'subagent' END AS caller, CAST(sum(user_id + event_id % 10) AS BIGINT) AS tokens FROM events GROUP BY 1")
def token_usage_by_caller(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    caller = F.when(F.col("event_type") == "error", "agent").when(F.col("event_type") == "click", "middleware:x").otherwise(F.concat(F.lit("subagent:"), "event_type"))
    usage = e.select(F.col("event_id").alias("source_run_id"), caller.alias("caller"), F.lit(None).cast("long").alias("total_tokens"), F.col("user_id").cast("long").alias("input_tokens"), (F.col("event_id") % 10).cast("long").alias("output_tokens"))
    return aggregate.distinct_usage(usage)


@query("event_append", "SELECT event_id, CAST(100 + row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS seq, CASE WHEN event_id % 2 = 0 THEN 6 ELSE 9 END AS size, event_id % 2 = 0 AS cut FROM events WHERE user_id = 7")
def event_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id = 7")
    category = F.when(F.col("event_id") % 2 == 0, "trace").otherwise("message")
    batch = e.select("event_id", "ts", F.lit("t").alias("thread_id"), category.alias("category"), F.lit("漢字é1").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"))
    last = spark.createDataFrame([("t", 40), ("t", 100), ("u", 900)], "thread_id string, seq int")
    out = store.append_events(batch, last, [F.col("ts"), F.col("event_id")], max_trace=7)
    return out.select("event_id", "seq", F.octet_length("content").alias("size"), F.coalesce(F.col("metadata")["content_truncated"] == "true", F.lit(False)).alias("cut"))


@query("cluster_names", "SELECT c_nationkey AS nation, 'G' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, max(c_custkey) DESC, c_nationkey) AS VARCHAR), 3, '0') AS name, count(*) AS size FROM customer GROUP BY 1")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    return graph.cluster_stats(table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", [], [], ["c_custkey"]).select("nation", "name", "size")


@query("risk_order", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS INTEGER) AS place FROM part")
def risk_order(spark: SparkSession, d: str) -> DataFrame:
    # places in a stable order by risk: counts of each risk come first, so no task ranks the whole table
    part = table(spark, d, "part").select("p_partkey", "p_size")
    return aggregate.places(part, "p_size", "p_partkey")


@query("probe_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 4 = 0 THEN 'no_results' WHEN event_id % 4 = 1 THEN 'direct_hit' ELSE 'indirect_hit' END AS class FROM events")
def probe_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    previews = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("Key"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return table(spark, d, "events").select("event_id", values.probe_class(F.col("event_type"), previews, F.lit("kEY")).alias("class"))


@query("fingerprint_jaccard", "WITH g AS (SELECT n_nationkey, n_regionkey, list_distinct(list_transform(range(1, length(lower(n_name)) - 1), lambda i: substr(regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g'), i, 3))) AS f0, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '', 'g')) AS c FROM nation), f AS (SELECT n_nationkey, n_regionkey, CASE WHEN length(c) >= 3 THEN list_distinct(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) WHEN length(c) > 0 THEN [c] ELSE [] END AS s FROM g) SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS similarity FROM f a JOIN f b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def fingerprint_jaccard(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", text.fingerprint(F.col("n_name")).alias("s"))
    a, b = (n.select(F.col("n_nationkey").alias(k), "n_regionkey", F.col("s").alias(f"s{k}")) for k in "ab")
    return a.join(F.broadcast(b), "n_regionkey").where("a < b").select("a", "b", F.round(text.jaccard(F.col("sa"), F.col("sb")), 9).alias("similarity"))
