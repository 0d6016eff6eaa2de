"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """a, b (links between nodes) to node, root: the least node reachable. Nodes without links are left out.

    Every round takes the least label of the neighbours, then the label of the
    label, so paths shorten at least by half; each round starts from a table.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        # The root of a label: hot labels are many rows on the side that AQE may split.
        before, best = labels, cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")))
        up = best.select(F.col("node").alias("up_node"), F.col("root").alias("up"))
        labels = cut(best.join(up, best["root"] == up["up_node"], "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        drop(before, best)
        if labels.where("root <> was").isEmpty():
            drop(both)
            return labels.select("node", "root")
        labels = labels.drop("was")
