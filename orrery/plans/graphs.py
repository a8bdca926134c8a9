"""Similarity, graph and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import aggregate, graph, similarity
from orrery.plans.registry import query, table

_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
#: Near-duplicates by five words, 0.8 or more; a text of fewer words is one shingle.
_FIVE_WORDS = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k))"""


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similarity.similar_classes(table(spark, d, "documents"), "doc_id", text.words(F.col("text")), 0.8, 5)


@query("jaccard_pairs", f"WITH {_FIVE_WORDS} SELECT a, b, round(similarity, 9) AS similarity FROM e")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = similarity.similar_pairs(table(spark, d, "documents"), "doc_id", text.words(F.col("text")), 0.8, 5)
    return pairs.withColumn("similarity", F.round("similarity", 9))


@query("greedy_near_dup")
def greedy_near_dup(spark: SparkSession, d: str) -> DataFrame:
    ranks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.struct(-F.col("n_chars"), "doc_id").alias("rank"))
    members, pairs = _classes(spark, d)
    return similarity.greedy_keep_classes(members, pairs.select("a", "b"), ranks)


@query("components", f"WITH RECURSIVE {_FIVE_WORDS}, u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id")
def components(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _classes(spark, d)
    copies = members.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return graph.connected_components(pairs.select("a", "b").unionByName(copies))


@query("cluster_stats", "SELECT c_nationkey AS nation, count(*) AS size, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, max(c_custkey) AS max_key FROM customer GROUP BY 1")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = graph.cluster_stats(table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", ["c_mktsegment"], [], ["c_custkey"])
    return stats.select("nation", "size", F.array_join("c_mktsegment", ",").alias("segments"), F.col("max_c_custkey").alias("max_key"))


_MODAL = "(SELECT l_suppkey, brand FROM (SELECT l_suppkey, p_brand AS brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r = 1)"


@query("dominant_template_clusters", f"WITH m AS {_MODAL}, f AS (SELECT s_suppkey, max(CAST(s_acctbal > 3000 AS INT)) AS flag FROM supplier GROUP BY 1) SELECT brand AS p_brand, count(*) AS size, CAST(sum(flag) AS BIGINT) AS flagged FROM m JOIN f ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(*) >= 3 AND sum(flag) >= greatest(2.0, 0.4 * count(*))")
def dominant_template_clusters(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    flagged = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 3000).alias("bad"))
    return graph.dominant_groups(lines.join(flagged, "l_suppkey"), "l_suppkey", "p_brand", F.col("bad"), 3)


@query("co_occurrence_pairs", "WITH e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem), f AS (SELECT k FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30) SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.k = y.k AND x.id < y.id WHERE x.k IN (SELECT k FROM f) GROUP BY ALL")
def co_occurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrences(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("weighted_edges", "WITH e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS id FROM lineitem), f AS (SELECT k FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), p AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.k = y.k AND x.id < y.id WHERE x.k IN (SELECT k FROM f) GROUP BY ALL) SELECT a, b, CAST(sum(n * 2 + n * 1) AS DOUBLE) AS strength FROM p GROUP BY ALL HAVING sum(n * 3) >= 18")
def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.co_occurrences(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")
    return graph.weighted_edges(pairs.withColumn("kind", F.explode(F.array(F.lit("image"), F.lit("template")))), {"seller": 3, "image": 2, "template": 1}, 18)


@query("super_summary", "SELECT r_name, count(*) AS n, array_to_string(list_slice(list_sort(list(n_name)), 1, 8), ',') AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def super_summary(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list("n_name")), 1, 8), ",").alias("names"))


@query("group_reputation", "SELECT source, count(*) FILTER (quality = 0) AS high, count(*) FILTER (quality = 1) AS medium, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def group_reputation(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").withColumn("risk_level", F.when(F.col("quality") == 0, "HIGH").otherwise("Medium"))
    return aggregate.reputation(records, "source")
