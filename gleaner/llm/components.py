"""Connected components over an edge table, without gathering a group or the edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is connected with.

    Each round takes the smallest label among neighbours, then follows labels of labels, so
    long chains need a number of rounds that grows with the logarithm of their length. Every
    round is written to the shared folder. Nodes without an edge aren't returned.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    links = materialize(both, "cc-links")
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-labels")
    while True:
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        nearer = materialize(nearer, "cc-near")
        jump = nearer.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = nearer.join(jump, nearer["root"] == F.col("_n")).select("node", "old", F.least("root", "_r").alias("root"))
        new = materialize(new, "cc-labels")
        moved = new.filter("root <> old").limit(1).count()
        discard(labels)
        discard(nearer)
        if not moved:
            discard(links)
            return new.select("node", "root")
        labels = new
