"""Connected components of a link table, by label passing with shortcuts.

Each round every node takes the least label among its own and its neighbours',
then the label of the node that its label names, so that long chains shrink
by halves.  Rounds are written to the shared folder, which cuts lineage; hot
nodes are safe since labels are combined before each shuffle.  Nothing but a
count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, label (the least node of its component) of all nodes with links.

    Null ends and loops are left out; no links, no rows."""
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        taken = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        # the label of the label, from the last round, can only be as low or lower
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        nxt = staged(taken.join(jump, "_new").select("node", F.least("_new", "_far").alias("label"), (F.least("_new", "_far") != F.col("label")).alias("moved")), "labels")
        labels = nxt.select("node", "label")
        if not nxt.where("moved").limit(1).count():
            return labels
