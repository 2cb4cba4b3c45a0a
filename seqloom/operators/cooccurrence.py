"""Item co-occurrence inside user sequences and its shifted positive PMI."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.operators.sequences import context_pairs


def skipgram_pairs(positions: DataFrame, window: int = 5, **columns) -> DataFrame:
    """(center, context) for both directions of every pair at most ``window`` apart."""
    pairs = context_pairs(positions, window, **columns)
    both = F.array(
        F.struct(F.col("center").alias("center"), F.col("context").alias("context")),
        F.struct(F.col("context").alias("center"), F.col("center").alias("context")),
    )
    return pairs.select(F.inline(both))


def cooccurrence(positions: DataFrame, window: int = 5, **columns) -> DataFrame:
    """(item_i, item_j, weight): symmetric sum of 1/distance; repeats of an item count twice.

    Pairs are counted per distance on the unordered pair, which halves the shuffle and makes
    the sum independent of row order, and mirrored afterwards.
    """
    pairs = context_pairs(positions, window, **columns)
    counted = (
        pairs.groupBy(
            F.least("center", "context").alias("a"), F.greatest("center", "context").alias("b")
        )
        .agg(*[F.count_if(F.col("distance") == d).alias(f"_d{d}") for d in range(1, window + 1)])
        .withColumn("w", sum((F.col(f"_d{d}") / F.lit(float(d)) for d in range(1, window + 1)), F.lit(0.0)))
    )
    cells = F.when(
        F.col("a") == F.col("b"),
        F.array(F.struct(F.col("a").alias("item_i"), F.col("b").alias("item_j"), (F.col("w") * 2).alias("weight"))),
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("item_i"), F.col("b").alias("item_j"), F.col("w").alias("weight")),
            F.struct(F.col("b").alias("item_i"), F.col("a").alias("item_j"), F.col("w").alias("weight")),
        )
    )
    return counted.select(F.inline(cells))


def sppmi(cells: DataFrame, shift: float = 1.0, keep_zeros: bool = False) -> DataFrame:
    """(item_i, item_j, sppmi): max(ln(c·T / (r_i·r_j)) - ln(shift), 0) of non-empty cells.

    Cells without co-occurrence are 0 for every shift >= 1; smaller shifts are rejected.
    """
    if shift < 1:
        raise ValueError("shift must be at least 1: smaller shifts make empty cells positive")
    margins = cells.groupBy("item_i").agg(F.sum("weight").alias("margin"))
    total = margins.agg(F.sum("margin")).scalar()
    left = margins.select("item_i", F.col("margin").alias("r_i"))
    right = margins.select(F.col("item_i").alias("item_j"), F.col("margin").alias("r_j"))
    ratio = F.col("weight") * total / (F.col("r_i") * F.col("r_j"))
    value = F.greatest(F.log(ratio) - F.log(F.lit(float(shift))), F.lit(0.0))
    scored = cells.join(left, "item_i").join(right, "item_j").select(
        "item_i", "item_j", value.alias("sppmi")
    )
    return scored if keep_zeros else scored.filter(F.col("sppmi") > 0)
