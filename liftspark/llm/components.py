"""Connected components of a link table by contraction, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of the links (columns a, b) the smallest node that it reaches.

    Each level gives a node its smallest neighbour as a parent, follows parents
    twice, and contracts the links to the parents; a star is gone after one
    level, a path after a number of levels that grows with the logarithm of
    its length. Every level is written, so lineage stays short. Minima are
    pre-aggregated; the joins are plain ones of two shuffled sides, so that
    adaptive execution splits what a node with very many links has on one side."""
    with scratch(links.sparkSession):
        pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = written(pairs, "links")
        labels = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        while not pairs.isEmpty():
            up = pairs.groupBy("a").agg(F.min("b").alias("p"))
            for _ in range(2):
                above = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
                up = up.join(above, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
            up = written(up, "parents")
            pairs = pairs.join(up, "a").select(F.col("p").alias("x"), "b").join(up.select(F.col("a").alias("b"), "p"), "b", "left").select("x", F.coalesce("p", "b").alias("y"))
            pairs = written(pairs.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
            labels = labels.join(up.select(F.col("a").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        return written(labels, "labels", lasting=True)
