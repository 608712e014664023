"""Connected components by labels and shortcuts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.sources.staging import stage


def components(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """Per node: the least node that links (node, centre) connect it with, as ``component``.

    In each round a node takes the least label around it and then that label's own
    label, so the distance to the least node is halved. Only nodes with links take part;
    labels are least values, which are combined before rows are sent, so a node with any
    number of links is no task's load.
    """
    alone = nodes.select("node", F.col("node").alias("component"))
    if links is None:
        return alone
    both = links.select(F.col("node").alias("a"), F.col("centre").alias("b"))
    both = stage(both.union(both.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b")
        near = near.groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        to = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        new = stage(
            moved.join(to, "next").select("a", F.col("label").alias("old"), F.least("next", "far").alias("label")),
            "labels",
        )
        done = new.filter("label <> old").isEmpty()
        labels = new.select("a", "label")
        if done:
            break
    named = labels.select(F.col("a").alias("node"), F.col("label").alias("linked"))
    return alone.join(named, "node", "left").select(
        "node", F.coalesce("linked", "component").alias("component")
    )
