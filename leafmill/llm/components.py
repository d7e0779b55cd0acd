"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash

#: Bytes of a pair of nodes. What a hub's many edges are joined with is a written table, so that the join broadcasts it if it is small, and can split the hub's partition if it isn't.
NODE_BYTES = 64


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    least = small(stash(least, "least"), NODE_BYTES)
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = small(stash(down.groupBy("a").agg(F.min("b").alias("m")), "least"), NODE_BYTES)
    other = down.join(least.select(F.col("a").alias("k"), "m"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node of an edge (a, b), a <> b, that isn't its component's least: `a`, and that least node as `b`.

    Every round's edges are written to the shared folder, so a lost executor costs no lineage. The number of rounds grows
    with the logarithm of the longest path.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    before = mark(edges)
    while True:
        edges = stash(_small_star(_large_star(edges)), "edges")
        if (now := mark(edges)) == before or not now[0]:
            return edges
        before = now
