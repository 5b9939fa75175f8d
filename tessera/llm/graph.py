"""Connected components of an edge table, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (columns a, b).

    Each round ties all neighbours of a node to its smallest neighbour, first
    those above it and then those below it; the number of rounds grows with the
    logarithm of the longest chain. Minima are combined before the shuffle, so
    a node with very many neighbours is one row per task; every round is
    written to the shared folder. Only a count and a checksum reach the driver.
    """
    def oriented(df):
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def least(df):
        return df.groupBy("a").agg(F.min("b").alias("m"))

    current, before = C.written(oriented(edges), "edges"), None
    while True:
        state = tuple(current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0))).first())
        if state == before or not state[0]:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select("a", F.least("a", "m").alias("m"))
        large = oriented(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        tied = large.join(least(large), "a")
        small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            tied.select("a", F.col("m").alias("b")))
        current = C.written(oriented(small), "edges")
