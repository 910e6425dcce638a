"""Connected components by alternating large and small stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Link each node's greater neighbours to the least of its neighbourhood; rows may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of them; edges point from greater to lesser."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges from greater to lesser nodes are stars: no leaf has two centres or is one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    seen = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return seen.where("leaf + centre > 1 and leaf > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``label`` (the component's least node) of every node that has an edge (u, v) to another.

    Edges that are stars already, such as those of tasks that saw whole components, need no round.
    """
    pointed = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(pointed, "stars")
    for _ in range(rounds):
        if _settled(now):
            break
        now = staged(_small(_large(now)), "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
