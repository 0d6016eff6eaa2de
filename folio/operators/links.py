"""Walks along links: how far everything is from every root, safe against cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(edges: DataFrame, roots: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """root, node, depth of all nodes that links (src, dst) reach from each root (root): the shortest way, the root itself at 0.

    One join a step: only nodes that a root sees for the first time go on, so
    a cycle ends where it closes. ``keep`` writes a table and reads it again.
    Null ends are no links; links and roots may be repeated. ``most`` ends the
    walk after so many steps.
    """
    links = keep(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    seen = keep(roots.where("root is not null").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = front.join(links, front["node"] == links["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def reach(walked: DataFrame) -> DataFrame:
    """root, n_nodes (without the root), depth of the farthest one."""
    return walked.groupBy("root").agg((F.count("*") - 1).alias("n_nodes"), F.max("depth").alias("depth"))
