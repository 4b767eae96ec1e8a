"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import written


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node that
    has an edge.  ``edges(a, b)`` may repeat and go either way.

    Every round a node takes the smallest label around it, then the label of
    that label.  The smallest label travels at least twice as far each round
    along stars and chains, so the number of rounds grows with the logarithm
    of a component's width.  The minimum is taken with partial sums before
    each shuffle, so a node with a third of all edges costs one row a task.
    Each round's labels are a table in the shared folder; only a count of
    changes comes to the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "cc-labels")
    def step(now: DataFrame) -> DataFrame:
        near = (both.join(now.withColumnsRenamed({"node": "b"}), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        jump = now.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        return (now.join(near, "node").withColumn("mid", F.least("label", "near")).join(jump, "mid")
                .select("node", "old", F.least("mid", "far").alias("label")))

    while True:
        new = written(step(labels.withColumn("old", F.col("label"))), "cc-labels")
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
