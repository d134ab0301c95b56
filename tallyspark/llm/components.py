"""Connected components by rounds of joins, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) undirected; the result (node, component) has each node of
    a link with the smallest node it can reach.

    A round hooks each node to its smallest neighbour, follows the hooks to their
    roots (chains halve with each step, one row a node), and keeps of the links
    those that join different roots, once each.  So all links are
    joined in the first round only; afterwards about one for each tree is left.
    Neighbours meet in an aggregate with map-side combining, so a node with many
    links is spread over tasks."""
    edges = written(_between(links.select("a", "b")))
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        roots = _roots(written(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))))
        edges = written(_between(mapped(edges, roots)))
        later = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        new = roots.join(labels, "node", "left_anti").select("node", F.col("root").alias("component"))
        labels = written(later.union(new))
    return labels


def mapped(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` between the roots of their ends; an end that has none stays itself."""
    one, two = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    return links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def _between(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(hooks: DataFrame) -> DataFrame:
    """The end of each node's chain of hooks."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
        hooks = after.select("node", "root")
        if after.where("moved").isEmpty():
            return hooks
