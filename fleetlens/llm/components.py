"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction; edges are (u, v).

    Each node sends what it is linked to the least node it knows: in the large
    step the greater neighbours, in the small step the smaller ones and itself.
    The least node of each is a minimum with map-side combine, joined back.
    """
    if large:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("w"), F.least("u", "m").alias("m")
        )
        joined = both.where("v > u").join(least, F.col("u") == F.col("w"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    joined = down.join(least, F.col("u") == F.col("w"))
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return linked.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id of its component) of every node that has an edge.

    ``edges`` has two integer columns. Each round writes its edges to the shared
    folder; the rounds are about the logarithm of the longest path.
    """
    a, b = edges.columns
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    )
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).collect()[0]
        if state == before or not state["n"]:
            break
        before = state
        now = stored(_stars(_stars(now, large=True), large=False))
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.union(roots)
