"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in ``edges`` (columns a, b, both long).

    Each round is a large-star and a small-star step.  Minima are aggregated
    before their shuffle and joined back, so that a node with very many
    neighbours is only ever split, never gathered.  Loops and null ends are
    ignored; an empty table gives an empty result.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = settle(e)
    mark = None
    while True:  # settles in a logarithmic number of rounds
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to its minimum
        e = e.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours move to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
