"""Connected components of an edge table, by alternating large and small stars; all state is in stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import rows_of, scratch, small_side, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger, or else the smaller ones and the node) to the smallest of them all."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low")), "star")
    out = both.join(small_side(lowest), F.col("a") == F.col("at"))
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select(F.col("at").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the smallest node that each node of an edge is connected with, itself included.

    The count of edges never grows, a hub's edges move in one join, and the rounds are about the logarithm of the longest path.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        with scratch() as keep:
            now = keep(stored(_star(stored(_star(now, True), "edges"), False), "edges"))
        # Stars only: no node is below two others, and none below one is above another.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not rows_of(now) or ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
