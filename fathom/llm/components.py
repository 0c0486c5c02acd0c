"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each node that has an edge with the smallest node id of its component.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the
    longest path, each is two aggregations, and no component is ever gathered. Every round's edges
    are cut to the checkpoint folder. Self-loops and NULLs are ignored; an empty input gives no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    pairs = cut(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = cut(small)
        if small.exceptAll(pairs.select("u", "v")).isEmpty() and pairs.count() == small.count():
            break
        pairs = small
    members = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
