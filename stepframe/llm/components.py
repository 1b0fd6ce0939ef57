"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.shared import stored

ROUNDS = 60


def _least(edges: DataFrame, own: bool = True) -> DataFrame:
    """``edges`` with m, the least neighbour of u (or u itself): counted with partial sums and joined back, so a hub's links are not one group."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumn("m", F.least("u", "m")) if own else least, "u")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a long, b long); the label is the least node of its component.

    Each step is a shuffle of at most as many rows as there are links, written to the shared folder; the number of steps grows
    with the logarithm of the longest chain. A node that very many others link to costs its links' rows, never their pairs.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), "m").select("u", F.col("m").alias("v")).distinct()
        small = _least(large, own=False).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = stored(small, "links")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        was = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if same == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
