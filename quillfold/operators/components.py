"""Connected components of an undirected graph, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.session import cut


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); ``root`` is the smallest node of its component.

    Each round halves distances in long chains, so rounds grow with the
    logarithm of the longest chain; all sums are hash aggregations with map-side
    partials, so a hub of any degree sends one row per task. Each round is
    written to the shared folder. Self-loops and repeated edges do no harm.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()
    links = cut(both, "edges")
    labels = cut(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = hooked.join(above, "root", "left").select("node", "old", F.least("root", "above").alias("root"))
        new = cut(jumped.select("node", "root", (F.col("old") != F.col("root")).alias("changed")), "labels")
        labels = new.select("node", "root")
        if new.filter("changed").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
