"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of
    ``links`` (columns a, b; any order, repeats and loops allowed, no nulls).

    Each round gives a node the least label among itself and its neighbours
    (partial aggregates keep a hub's edges apart; its join partition can be
    split), then follows labels of labels. Both halve distances, so long chains
    take a logarithmic number of rounds; the state is written between rounds.
    When neighbours change nothing, all of a component have one label.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    kind = edges.schema["a"].dataType
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels, edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast(kind).alias("old"))
        near = seen.unionByName(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        near = materialise(near, "labels")
        if near.filter("label < old").isEmpty():
            return labels
        up = near.select(F.col("node").alias("via"), F.col("label").alias("higher"))
        labels = materialise(near.join(up, near["label"] == up["via"]).select("node", F.least("label", "higher").alias("label")), "labels")
