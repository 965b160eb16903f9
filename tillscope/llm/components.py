"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.session import drop_staged, stage


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """The component of every node of ``links`` (a, b, longs): ``node``, ``component``, its least node.

    Alternates two steps until nothing changes: every node hands its least neighbour to
    its larger neighbours, then to its smaller ones. The number of rounds grows with the logarithm of
    the longest chain. Every round is a shuffle of the edges that are left and is written
    to the shared folder, and that of the round before deleted; nothing but a count and a checksum comes to the driver.
    """
    edges = stage(_directed(links), "edges")
    before = _digest(edges)
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").toDF("u", "v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select("v", "m").toDF("u", "v").union(met.select("u", "m").toDF("u", "v"))
        former, edges = edges, stage(small.where("u <> v").distinct(), "edges")
        drop_staged(former)
        after = _digest(edges)
        if after == before:
            break
        before = after
    stars = edges.toDF("node", "component")
    return stars.union(stars.select("component", "component")).distinct()
