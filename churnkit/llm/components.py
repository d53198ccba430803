"""Connected components of an edge table, by alternating stars.

Each round joins every node to the smallest node of its neighbourhood, first
over larger neighbours (large star), then over smaller ones (small star),
until nothing changes. Each round is a few joins on the edge table and is
written out, so lineage stays short; no links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.session import materialize


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("a", "b") % (1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    own = least.select("a", F.col("least").alias("b"))
    others = down.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return own.unionByName(others).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root: the component's smallest node."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _summary(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = _summary(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
