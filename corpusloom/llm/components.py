"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for each node of links (a long, b long) that isn't its own root.

    Large and small stars take turns: in the first every node hands its larger neighbours to its smallest neighbour, in the second its
    smaller ones. Both reduce a node's neighbours to their minimum by partial aggregation and then join it, so that a node with very many links is
    split like any skewed join. It ends when a round changes nothing, as then all links lead to a root; rounds grow with the logarithm of the longest path.
    """

    def forward(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def seen(pairs: DataFrame) -> tuple:
        """The number of pairs and a sum over their hashes, by which equal sets of pairs are told."""
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    stars = checkpointed(forward(links))
    before, now = None, seen(stars)
    while now[0] and now != before:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = forward(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = checkpointed(forward(small))
        before, now = now, seen(stars)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
