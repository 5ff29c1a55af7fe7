"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import delete, written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return _distinct(both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.unionByName(least.withColumnRenamed("m", "b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges between long ids -> (node, root) for every node with an edge; root is its component's least id.

    Each round writes its edges to the shared folder and removes those before, so neither lineage nor disk adds up; rounds grow
    with the logarithm of the longest path. Hot nodes meet only in joins that split skew and in partial aggregates.
    """
    (now, path), mark = written(_distinct(edges.where("a <> b")), "components"), None
    while True:
        before, (now, path) = path, written(_small_star(_large_star(now)), "components")
        delete(edges.sparkSession, before)
        then, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == then or not mark[0]:
            break
    roots = now.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
