"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every end of a link, ``node`` and ``component``: the smallest node that links reach.

    Links are pairs of numbers in any order, repeated or not; links with a null end or of a node to itself are left
    out. Each round hangs every node's larger neighbours, and then its smaller ones, to the smallest of them, which
    halves the depth of what is left; rounds end when only stars remain. A round's links are written to the shared
    folder. A node of many links is one sum per task before rows are moved, and joins on it can be split.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct())  # from every node to smaller ones
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Numbers that change when the links do."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
