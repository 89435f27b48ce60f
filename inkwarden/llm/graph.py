"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reached.

    A large star links a node's larger neighbours to the smallest of its
    neighbourhood, a small star its smaller ones. Both keep the components and
    end with a star around each smallest node. Minima are partial aggregates
    before the shuffle, and the joins are ones that adaptive execution can split.
    Rounds go on until nothing changes, which takes about the logarithm of the
    longest path, squared at worst.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.filter("a > b").groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.filter("a > b").join(lower, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        found = small.filter("a > b").unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = cut_lineage(found)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
