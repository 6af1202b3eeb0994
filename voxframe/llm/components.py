"""Connected components of a link table, by joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``links(a, b)`` of type long.

    Alternates the large-star and small-star steps of Kiveris and others (2014): each node ties its larger
    neighbours, then its smaller ones, to the least node it knows. A step keeps the number of links and
    the rounds grow with the logarithm of the components' size. Each round is cut off at a checkpoint.
    """
    links = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: every neighbour above the node, and so the node itself, links to the least one around.
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: of a node's smaller neighbours, and of itself, all link to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        links = checkpointed(small)
        # A star forest has no node that is both tied and tied to; then both steps leave it as it is.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
