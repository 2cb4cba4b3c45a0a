"""Seeded sampling that does not depend on partitioning: uniforms are hashes of row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqloom.operators.ordering import last_at_or_before, running_totals

_UNIT = 1 << 53
_DECIMAL = "decimal(38,18)"


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends only on the seed and the keys."""
    bits = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(_UNIT))
    return bits.cast("double") / F.lit(float(_UNIT))


def uniform_int(below: Column, seed: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), below.cast("bigint"))


def gaussian(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform of two hash uniforms."""
    u = F.lit(1.0) - uniform(seed, F.lit("radius"), *keys)
    angle = F.lit(2.0) * F.pi() * uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(angle)


def draw_by_weight(draws: DataFrame, weights: DataFrame, seed: int = 0, weight: str = "weight") -> DataFrame:
    """One item per row of ``draws`` (key column ``draw_id``), with replacement, by weight.

    The uniform of each draw is looked up in the cumulative weights. Both are sorted together
    instead of being joined by range, so heavy and very many light items cost the same.
    Sums are decimal, hence exact and independent of their order.
    """
    items = weights.filter(F.col(weight) > 0).select(
        "item_idx", F.col(weight).cast("decimal(28,18)").alias("_w")
    )
    summed = running_totals(items, "item_idx", ["_w"])
    marks = summed.select(F.col("_w_before").cast(_DECIMAL).alias("_x"), "item_idx").filter(
        F.col("_x").isNotNull()
    )
    total = items.agg(F.sum("_w").cast("double")).scalar()
    place = (uniform(seed, "draw_id") * total).cast(_DECIMAL)
    probes = draws.withColumn("_x", place).withColumn("_h", F.xxhash64("draw_id"))
    found = last_at_or_before(probes, marks, ["_x"], "item_idx", "_h")
    return found.drop("_x", "_h")


def sample_with_replacement(weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` weighted draws (draw_id, item_idx)."""
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw_id"))
    return draw_by_weight(draws, weights, seed)


def noise_negatives(pairs: DataFrame, noise: DataFrame, per_pair: int, seed: int = 0) -> DataFrame:
    """``per_pair`` draws from the noise distribution for every row (key column ``pair_id``)."""
    draws = pairs.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))).alias("negative_no")
    ).withColumn("draw_id", F.xxhash64("pair_id", "negative_no"))
    drawn = draw_by_weight(draws, noise, seed, weight="prob")
    return drawn.withColumnRenamed("item_idx", "negative").drop("draw_id")


def positives(indexed: DataFrame) -> DataFrame:
    """Distinct (user_idx, item_idx)."""
    return indexed.select("user_idx", "item_idx").distinct()


def uniform_negatives(
    rows: DataFrame, owned: DataFrame, n_items: int, seed: int = 0, key: str = "row_id"
) -> DataFrame:
    """Add ``negative``: a uniform item the row's user does not own, without retries.

    A random rank r among the items the user lacks is turned into an item: with the owned
    items sorted as p_0 < p_1 < …, it is r + #{j : p_j - j <= r}. The count is an as-of
    lookup on (user, p_j - j). Users who own the whole catalogue have no negatives and are
    left out.
    """
    ranked = _owned_ranks(owned)
    sizes = owned.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_owned"))
    # Several owned items can share p_j - j (a run of neighbours): the last one counts them all.
    marks = ranked.groupBy("user_idx", (F.col("item_idx") - F.col("_j")).alias("_x")).agg(
        F.max(F.col("_j") + 1).alias("_skip")
    )
    zero = sizes.select("user_idx", F.lit(-1).cast("bigint").alias("_x"), F.lit(0).cast("bigint").alias("_skip"))
    marks = marks.select("user_idx", F.col("_x").cast("bigint"), F.col("_skip").cast("bigint")).unionByName(zero)
    probes = (
        rows.join(sizes, "user_idx", "left")
        .withColumn("_lacking", F.lit(n_items) - F.coalesce("_owned", F.lit(0)))
        .filter(F.col("_lacking") > 0)
        .withColumn("_x", uniform_int(F.col("_lacking"), seed, key))
        .withColumn("_h", F.xxhash64(key))
        .drop("_owned", "_lacking")
    )
    found = last_at_or_before(probes, marks, ["user_idx", "_x"], "_skip", "_h")
    # A user without any owned item may pick up the mark of the user before; those own nothing.
    skip = F.when(F.col("_known"), F.col("_skip")).otherwise(F.lit(0))
    known = sizes.select("user_idx", F.lit(True).alias("_known"))
    return found.join(known, "user_idx", "left").select(
        *rows.columns, (F.col("_x") + F.coalesce(skip, F.lit(0))).cast("int").alias("negative")
    )


def _owned_ranks(owned: DataFrame) -> DataFrame:
    """Rank of each owned item inside its user, counted per block of items.

    A user owning millions of items is ranked in blocks; block sizes are summed first.
    """
    block = F.expr("item_idx div 65536")
    blocked = owned.withColumn("_b", block)
    per_block = blocked.groupBy("user_idx", "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("user_idx").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        "user_idx", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy("user_idx", "_b").orderBy("item_idx")
    return blocked.withColumn("_r", F.row_number().over(inside) - 1).join(
        offsets, ["user_idx", "_b"]
    ).select("user_idx", "item_idx", (F.col("_before") + F.col("_r")).alias("_j"))


def epoch_order(df: DataFrame, keys: list[str], seed: int, epoch: int) -> DataFrame:
    """A permutation of the rows that is fixed by seed and epoch."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), *keys), *keys)
