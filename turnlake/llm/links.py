"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for each node of links (a, b: long).

    Star contraction: in turn every node hands its larger neighbours, then its
    smaller ones, to the least node that it knows, until all links are stars
    around their least node. Links stay a distributed table throughout; rounds
    grow with the logarithm of the longest path.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(ends)
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = written(large)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct("m", F.col("b").alias("v")), F.struct("m", F.col("a").alias("v")))).alias("x")).select(F.col("x.m").alias("a"), F.col("x.v").alias("b"))
        old, now = now, written(small.where("a < b").distinct())
        before, mark = mark, _mark(now)
        drop(old, large)
        if mark == before:
            nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
