"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.session import materialize_with


def _rewire(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node hands its neighbours to the smallest one it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(
        F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
    )
    return small.select("e.u", "e.v").filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` with node columns u and v -> node, root: the smallest node of its component.

    Nodes without an edge to another node do not occur. Each round is written, so that a lost
    executor costs its running tasks only; rounds end when one changes nothing.
    """
    figures = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    table, seen = materialize_with(pairs, "edges", figures)
    while seen["n"]:
        table, now = materialize_with(_rewire(table), "edges", figures)
        if now == seen:
            break
        seen = now
    return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
