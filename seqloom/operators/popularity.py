"""Item frequencies and what is derived from them: groups, penalties, weights, noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.operators.ordering import number_rows

GROUPS = ("cold", "mid", "hot")  # fixed values: group 0, 1, 2
STRATEGIES = ("equal_items", "quantile_frequency")


def target_frequency(samples: DataFrame, item_map: DataFrame, target: str = "target") -> DataFrame:
    """(item_idx, freq) over the whole catalogue; negative targets are ignored."""
    counts = (
        samples.filter(F.col(target) >= 0)
        .groupBy(F.col(target).alias("item_idx"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    return (
        item_map.select("item_idx")
        .join(counts, "item_idx", "left")
        .select("item_idx", F.coalesce("freq", F.lit(0)).alias("freq"))
    )


def frequency_quantiles(freq: DataFrame) -> DataFrame:
    """One row (q33, q66): exact quantiles with linear interpolation.

    Equal frequencies are counted first, so the quantile sees one row per distinct value.
    """
    histogram = freq.groupBy("freq").agg(F.count(F.lit(1)).alias("items"))
    return histogram.agg(
        F.percentile("freq", [1.0 / 3.0, 2.0 / 3.0], F.col("items")).alias("q")
    ).select(F.col("q")[0].alias("q33"), F.col("q")[1].alias("q66"))


def popularity_groups(freq: DataFrame, strategy: str = "equal_items") -> DataFrame:
    """(item_idx, freq, group_id, group): three groups by rank or by frequency quantile."""
    if strategy == "equal_items":
        ranked = number_rows(freq.select("item_idx", "freq"), ["freq", "item_idx"], "_rank")
        total = freq.agg(F.count(F.lit(1))).scalar()
        # Sizes differ by at most one; the first groups take the remainder.
        cold = F.ceil(total / 3)
        mid = cold + F.ceil((total - cold) / 2)
        group_id = F.when(F.col("_rank") < cold, 0).when(F.col("_rank") < mid, 1).otherwise(2)
    elif strategy == "quantile_frequency":
        ranked = freq.select("item_idx", "freq")
        quantiles = frequency_quantiles(freq)
        group_id = (
            F.when(F.col("freq") > quantiles.select("q66").scalar(), 2)
            .when(F.col("freq") > quantiles.select("q33").scalar(), 1)
            .otherwise(0)
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    named = ranked.withColumn("group_id", group_id)
    names = F.array(*[F.lit(g) for g in GROUPS])
    return named.select("item_idx", "freq", "group_id", names[F.col("group_id")].alias("group"))


def group_names(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GROUPS)), "group_id int, group string")


def group_summary(groups: DataFrame) -> DataFrame:
    """Items and frequency range per group; empty groups are kept with zeros."""
    found = groups.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("num_items"),
        F.min("freq").alias("min_frequency"),
        F.max("freq").alias("max_frequency"),
        F.avg("freq").alias("mean_frequency"),
    )
    return group_names(groups.sparkSession).join(found, "group_id", "left").na.fill(0).na.fill(0.0)


def popularity_penalty(freq: DataFrame) -> DataFrame:
    """(item_idx, penalty): ln(1 + freq) relative to its maximum, 0 when nothing was seen."""
    top = freq.agg(F.max(F.log1p("freq"))).scalar()
    share = F.coalesce(F.log1p("freq") / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    return freq.select("item_idx", share.alias("penalty"))


def inverse_frequency_weights(
    freq: DataFrame,
    power: float = 0.5,
    min_weight: float = 0.25,
    max_weight: float = 4.0,
    offset: float = 1.0,
) -> DataFrame:
    """(item_idx, weight): (freq + offset)^-power over its mean for seen items, clipped."""
    raw = F.pow(F.col("freq") + F.lit(float(offset)), F.lit(-float(power)))
    mean = freq.agg(F.avg(F.when(F.col("freq") > 0, raw))).scalar()
    scaled = raw / F.coalesce(F.greatest(mean, F.lit(1e-12)), F.lit(1.0))
    weight = F.least(F.greatest(scaled, F.lit(float(min_weight))), F.lit(float(max_weight)))
    return freq.select("item_idx", weight.alias("weight"))


def weight_summary(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.min("weight").alias("min_weight"),
        F.avg("weight").alias("mean_weight"),
        F.max("weight").alias("max_weight"),
    )


def noise_distribution(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """(item_idx, prob): max(freq, 1)^power over the whole catalogue, summing to one."""
    raw = F.pow(F.greatest("freq", F.lit(1)).cast("double"), F.lit(power))
    total = counts.agg(F.sum(raw)).scalar()
    return counts.select("item_idx", (raw / total).alias("prob"))
