"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.session import materialize


def components(edges: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of an undirected edge list; a component is named by its smallest node.

    After a given number of `rounds` a component may still be in parts, each named by a node that it is connected to. Each round takes the smallest label among the neighbours (map-side combined, so a hub's neighbours meet as
    partial minima), then jumps to the label's own label, which halves long paths. Every round is a written table.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(one.union(one.select("v", "u")).where("u != v"), "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = materialize(labels, "labels")
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = step.join(jump, step["label"] == jump["at"], "left").select(
            "node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old"
        )
        new = materialize(new, "labels")
        labels, done = new.select("node", "label"), done + 1
        if rounds is None and not new.where("label != old").limit(1).count():
            break
    return labels.withColumnRenamed("label", "component")
