"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_files, spread_join, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Returns a, b with b the smallest member of a's component, b < a.

    Each round is written in the shared folder. Stars are formed by partial minima and by joins that
    deal a hub's links to several tasks, so a member with very many links is never gathered in one.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while (now := _signature(edges)) != last and now[0]:
        last = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both, least, "a", ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(in_files(large, now[0]), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a", ["b"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(in_files(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), now[0]), "small-star")
    return edges
