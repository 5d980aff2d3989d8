"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs → (u, v): each vertex that is not the least of its component, and that least vertex.

    A large star points every larger neighbour of a vertex at the least one, a small star the smaller ones and
    itself, until nothing changes. Each round is written to the shared folder; no group of edges is collected.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = staged(_stars(both.where("v > u"), least).distinct(), "edges")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = staged(_stars(large, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if _digest(small) == _digest(edges):
            return small
        edges = small


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
