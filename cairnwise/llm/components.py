"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnwise.session import materialise

#: Times the edges are hooked to smallest neighbours before labels travel.
HOOKS = 2


def hooked(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a < b and the same components, most of them one a node.

    Every node hooks to its smallest neighbour below it; its other neighbours
    below are hooked to that one as well, and pairs that many nodes give become
    one. A node with many leaders so leaves a single edge behind, and what is
    left of its leaders is shared with all nodes like it.
    """
    low = F.min("a").over(Window.partitionBy("b"))
    seen = materialise(edges.select("a", "b", low.alias("low")), "hooks")
    leaders = seen.where("a <> low").select("low", F.col("a").alias("b")).distinct()
    return seen.where("a = low").select("low", "b").unionByName(leaders).distinct().select(F.col("low").alias("a"), "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (a, b); ``comp`` is its component's smallest node.

    Edges are first hooked to smallest neighbours, which leaves about one a node.
    Then every round takes the smallest label among a node's neighbours, and
    the label of that label, so the number of rounds grows with the logarithm of a
    component's diameter. Labels are written to the shared folder each round.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for _ in range(HOOKS):
        edges = hooked(edges)
    edges = materialise(edges, "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("comp").alias("before"), F.least("comp", "near").alias("comp")
        )
        upper = lower.select(F.col("node").alias("u"), F.col("comp").alias("jump"))
        after = materialise(
            lower.join(upper, lower["comp"] == upper["u"]).select("node", "before", F.least("comp", "jump").alias("comp")), "labels"
        )
        labels = after.select("node", "comp")
        if after.where("before <> comp").isEmpty():
            return labels
