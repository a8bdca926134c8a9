"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import folders, settled, shared_table


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component): for each id in the edges (columns a, b), the smallest id that it is connected with.

    Each round takes the least label of the neighbours, then the label's own label, and is written to the shared folder; it ends
    when a round changes nothing. Chains shorten at least by half in a round. No edges: no rows.
    """
    spark = edges.sparkSession
    both = shared_table(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).where("id != to").distinct(), "edges")
    labels = shared_table(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        first = len(folders(spark))
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = shared_table(step, "step")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        jumped = step.join(jump, "component").select("id", F.least("component", "far").alias("component"), (F.least("component", "far") != F.col("old")).alias("changed"))
        jumped = settled(jumped, "labels", first - 1)
        labels = jumped.select("id", "component")
        if jumped.where("changed").isEmpty():
            return labels
