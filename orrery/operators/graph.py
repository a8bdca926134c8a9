"""Pairs, weighted edges, connected components and cluster summaries."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the session names in spark.checkpoint.dir; a local one only where it is unset and all run in one process
    (ValueError elsewhere)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(told or "file://" + tempfile.mkdtemp(prefix="orrery-"))


#: Rows that a task takes: the number of tasks follows the rows, so what one task holds doesn't.
ROWS_A_TASK = 500_000
#: Parts that the nodes of a key are dealt to before they meet, so that a common key's rows are in many tasks.
PARTS = 64


def co_occurrences(df: DataFrame, key: str, node: str, least: int = 2, most: int | None = 30) -> DataFrame:
    """Pairs of nodes a < b that share a key, with the keys' number; keys with fewer than `least` or more than `most` nodes tell
    nothing and are left out (that is the operator's rule: common keys are no evidence).

    Of a key's nodes no more than `most` + 1 of each part are moved to meet, which is enough to tell that it is left out; the others'
    nodes are paired there, without a join. All shuffles have as many tasks as the rows ask for; Spark itself goes by compressed bytes
    or a fixed number, of which few make many rows.
    """
    known = df.select(F.col(key).alias("k"), F.col(node).alias("id")).where("k IS NOT NULL AND id IS NOT NULL")
    if most is None:
        each = known.distinct()
        sizes = each.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        ensure_checkpoints(df.sparkSession)
        # written before it is joined: with the aggregate in the join's stage, Spark can't split a key that a third of the rows have
        fit = each.join(sizes.select("k").checkpoint(), "k")
        a, b = fit.select("k", F.col("id").alias("a")), fit.select("k", F.col("id").alias("b"))
        pairs = a.join(b, "k").where("a < b")
    else:
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-known.count() // ROWS_A_TASK))
        # by node and by the task that reads it, so that neither a common key nor a row that is often repeated is left to one task
        part = F.pmod(F.hash("id", F.spark_partition_id()), F.lit(PARTS))
        each = known.withColumn("part", part).repartition(tasks, "k", "part").distinct()
        place = F.row_number().over(Window.partitionBy("k", "part").orderBy("id"))
        first = each.withColumn("place", place).where(F.col("place") <= most + 1)
        groups = first.select("k", "id").repartition(tasks, "k").groupBy("k").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        groups = groups.where((F.size("ids") >= least) & (F.size("ids") <= most))
        later = groups.select("ids", F.posexplode("ids").alias("p", "a"))
        pairs = later.select("a", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("b"))
        # a row is in (most - 1) / 2 pairs at most, so that a task has no more than about 4 * ROWS_A_TASK of them
        pairs = pairs.repartition(tasks * max(1, most // 8), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def weighted_edges(evidence: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """Edges (a, b) whose evidence (a, b, kind, n) weighs at least so much."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    return evidence.groupBy("a", "b").agg(F.sum(F.col("n") * weight).alias("strength")).where(F.col("strength") >= least)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in the edges (a, b), component being the least id reached.

    Labels move along edges and jump to their own label's label each round; rounds are checkpointed and end when nothing changes.
    """
    ensure_checkpoints(edges.sparkSession)
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct().checkpoint()
    labels = both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = step.join(jump, "component").select("id", F.least("component", "far").alias("component"), (F.least("component", "far") != F.col("old")).alias("changed")).checkpoint()
        labels = new.select("id", "component")
        if new.where("changed").isEmpty():
            return labels


def cluster_stats(records: DataFrame, component: str, sets: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """Size, distinct sorted values, sums and maxima of each cluster, numbered from the largest."""
    stats = records.groupBy(component).agg(
        F.count("*").alias("size"),
        *[F.sort_array(F.collect_set(c)).alias(c) for c in sets],
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
    )
    order = Window.orderBy(F.desc("size"), *[F.desc(f"max_{c}") for c in maxima], component)
    return stats.withColumn("name", F.format_string("G%03d", F.row_number().over(order)))


def modal(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(value).alias("v")))["v"].alias(value))


def dominant_groups(df: DataFrame, member: str, template: str, flagged: Column, least: int) -> DataFrame:
    """Members by their modal template: groups of at least `least` members of which at least max(2, 40 %) are flagged."""
    main = modal(df, member, template)
    marks = df.groupBy(member).agg(F.max(flagged.cast("int")).alias("flag"))
    groups = main.join(marks, member).groupBy(template).agg(F.count("*").alias("size"), F.sum("flag").alias("flagged"))
    return groups.where((F.col("size") >= least) & (F.col("flagged") >= F.greatest(F.lit(2.0), 0.4 * F.col("size"))))


def sample_clusters(members: DataFrame, component: str, order: Column, clusters: int, each: int) -> DataFrame:
    """Of the largest clusters, the first members by an order."""
    sizes = members.groupBy(component).agg(F.count("*").alias("size")).orderBy(F.desc("size"), component).limit(clusters)
    ranked = members.join(sizes, component).withColumn("rank", F.row_number().over(Window.partitionBy(component).orderBy(order)))
    return ranked.where(F.col("rank") <= each)
