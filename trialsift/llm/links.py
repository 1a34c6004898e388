"""Connected components of a links table by alternating star contraction, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialsift.llm.common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`links` (a, b) -> (node, root): every node that has a link, with the smallest node it reaches.

    Large-star and small-star steps: each node's neighbours are re-hung under
    its smallest neighbour, with the minimum taken by a map-side aggregation
    and joined back, so a node with very many links is never gathered into one
    row.  The links table is rewritten to the shared folder each round.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), "m")
            .where("a <> m")
            .select("a", F.col("m").alias("b"))
            .distinct()
        )
        edges = stored(small, "small-star")
        # A forest of stars is a fixed point: as many edges as distinct lower ends of none.
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("links did not contract; raise max_rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
