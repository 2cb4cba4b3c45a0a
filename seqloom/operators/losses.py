"""Loss and accuracy figures over prediction tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqloom.functions import vector as V

IGNORE = -100  # fixed value: label of positions that do not count


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` holds lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(values: Column | str) -> Column:
    x = (F.col(values) if isinstance(values, str) else values).cast("array<double>")
    return _with(
        F.array_max(x),
        lambda high: high + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - high))),
    )


def log_softmax(values: Column | str) -> Column:
    """Log-softmax of an array of logits."""
    x = (F.col(values) if isinstance(values, str) else values).cast("array<double>")
    return _with(log_sum_exp(x), lambda norm: F.transform(x, lambda v: v - norm))


def _runs(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` over consecutive runs of values; an empty run has its identity, or -inf."""
    size = np.diff(first)
    out = np.full(len(size), -np.inf if ufunc is np.maximum else 0.0)
    if (size > 0).any():
        out[size > 0] = ufunc.reduceat(values, first[:-1][size > 0])
    return out


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All logits of an array<array<double>> column, where its inner lists begin, and where its rows begin among those."""
    inner = column.flatten()
    rows = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    first = np.concatenate([[0], np.cumsum(inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64), first, rows


def _log_norms(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    high = _runs(values, first, np.maximum)
    with np.errstate(divide="ignore", invalid="ignore"):
        return high + np.log(_runs(np.exp(values - np.repeat(high, np.diff(first))), first, np.add))


def log_softmax_arrays(samples: DataFrame, logits: str = "logits", out: str = "log_probs") -> DataFrame:
    """Add ``out``: per row the log-softmax of every array of ``logits``, one after the other.

    Rows are worked off a batch at a time where they are; nothing is exploded or shuffled.
    """

    def run(batches):
        for batch in batches:
            values, first, rows = flat_lists(batch.column(logits))
            probs = values - np.repeat(_log_norms(values, first), np.diff(first))
            lists = pa.ListArray.from_arrays(pa.array(first[rows].astype(np.int32)), pa.array(probs))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    typed = samples.withColumn(logits, F.col(logits).cast("array<array<double>>"))
    return typed.mapInArrow(run, typed.withColumn(out, F.array(F.lit(0.0))).schema)


def cross_entropy_arrays(
    samples: DataFrame,
    logits: str = "logits",
    labels: str = "labels",
    label_smoothing: float = 0.0,
    batch: str | None = None,
    ranges: list[tuple[int, int]] | None = None,
    blocked: float = -1e9,
) -> DataFrame:
    """``masked_cross_entropy`` of rows that hold their logits and labels as arrays, one per position.

    With ``ranges`` (first token, end) of every position, logits of other tokens count as ``blocked``.
    Rows are worked off where they are; only sums by ``batch`` are shuffled.
    """

    def run(batches):
        for rows in batches:
            values, first, row_first = flat_lists(rows.column(0))
            size = np.diff(first)
            place = np.arange(len(size)) - np.repeat(row_first[:-1], np.diff(row_first))
            if ranges is not None:
                low, high = np.array(ranges).T
                token = np.arange(len(values)) - np.repeat(first[:-1], size)
                at = np.repeat(place, size)
                values = np.where((token >= low[at]) & (token < high[at]), values, blocked)
            goals = rows.column(1)
            given = goals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = goals.flatten().fill_null(IGNORE).to_numpy(zero_copy_only=False).astype(np.int64)
            label = np.full(len(size), IGNORE)
            goal_first = np.concatenate([[0], np.cumsum(given)])[:-1]
            has = place < np.repeat(given, np.diff(row_first))
            label[has] = flat[(np.repeat(goal_first, np.diff(row_first)) + place)[has]]
            counts = (label >= 0) & (label < size)
            norm = _log_norms(values, first)[counts]
            own = values[first[:-1][counts] + label[counts]]
            mean = (_runs(values, first, np.add) / np.maximum(size, 1))[counts]
            loss = (1 - label_smoothing) * (norm - own) + label_smoothing * (norm - mean)
            row = np.repeat(np.arange(rows.num_rows), np.diff(row_first))[counts]
            n = np.bincount(row, minlength=rows.num_rows)
            total = np.bincount(row, loss, rows.num_rows).astype(np.float64)  # without any row it counts integers
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(n), *rows.columns[2:]], ["total", "n", *rows.schema.names[2:]])

    kept = samples.select(
        F.col(logits).cast("array<array<double>>").alias("_logits"), F.col(labels).cast("array<int>").alias("_labels"), *([F.col(batch).alias("_batch")] if batch else [])
    )
    schema = kept.select(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"), *(["_batch"] if batch else [])).schema
    sums = kept.mapInArrow(run, schema).filter("n > 0")
    if batch:
        return sums.groupBy("_batch").agg((F.sum("total") / F.sum("n")).alias("loss")).agg(F.avg("loss").alias("loss"))
    return sums.agg((F.sum("total") / F.sum("n")).alias("loss"))


def log_softmax_rows(logits: DataFrame, key: list[str]) -> DataFrame:
    """Log-softmax over a long table with one row per (key, token) and column ``logit``."""
    group = W.partitionBy(*key)
    high = F.max("logit").over(group)
    shifted = logits.withColumn("_x", F.col("logit") - high)
    total = F.sum(F.exp("_x")).over(group)
    return shifted.withColumn("log_prob", F.col("_x") - F.log(total)).drop("_x")


def masked_cross_entropy(
    logits: DataFrame,
    key: list[str],
    label_smoothing: float = 0.0,
    batch: str | None = None,
) -> DataFrame:
    """Mean cross-entropy of (key, token, logit, label) rows with label not ``IGNORE``.

    With ``batch`` the mean of the batch means is returned, else the plain mean.
    """
    group = [*key, *([batch] if batch else []), "label"]
    rows = logits.filter(F.col("label") != IGNORE)
    highs = rows.groupBy(*group).agg(
        F.max("logit").alias("_high"),
        F.avg("logit").alias("_avg"),
        F.max(F.when(F.col("token") == F.col("label"), F.col("logit"))).alias("_own"),
    )
    sums = (
        rows.join(highs.select(*group, "_high"), group)
        .groupBy(*group)
        .agg(F.sum(F.exp(F.col("logit") - F.col("_high"))).alias("_sum"))
    )
    norm = F.col("_high") + F.log("_sum")
    smooth = F.lit(float(label_smoothing))
    losses = highs.join(sums, group).select(
        *group, ((1 - smooth) * (norm - F.col("_own")) + smooth * (norm - F.col("_avg"))).alias("loss")
    )
    if batch:
        losses = losses.groupBy(batch).agg(F.avg("loss").alias("loss"))
    return losses.agg(F.avg("loss").alias("loss"))


def masked_accuracy(samples: DataFrame, labels: str = "labels", predicted: str = "predicted") -> DataFrame:
    """Share of positions with label not ``IGNORE`` that were predicted right; 0 without any."""
    pairs = samples.select(F.inline(F.arrays_zip(F.col(labels).alias("l"), F.col(predicted).alias("p"))))
    counted = pairs.filter(F.col("l") != IGNORE).agg(
        F.count_if(F.col("l") == F.col("p")).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counted.select(
        "correct", "total", (F.col("correct") / F.greatest("total", F.lit(1))).alias("accuracy")
    )


def ranking_cross_entropy(ranked: DataFrame, temperature: float, weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean of log_sum_exp - target_score / temperature from ``rank_catalogue``.

    ``weights``: (item_idx, weight) of the targets; all ones when absent. A target without a weight
    is an error.
    """
    loss = F.col("log_sum_exp") - F.col("target_score") / F.lit(max(temperature, 1e-6))
    if weights is None:
        return ranked.agg(F.avg(loss).alias("ranking_loss"))
    found = weights.select(F.col("item_idx").alias("target"), F.col("weight").alias("_w"))
    joined = ranked.join(found, "target", "left").withColumn(
        "weight", F.coalesce("_w", F.raise_error(F.lit("a target has no weight")).cast("double"))
    )
    total = F.greatest(F.sum("weight"), F.lit(1e-6))
    return joined.agg((F.sum(loss * F.col("weight")) / total).alias("ranking_loss"))


def vector_mse(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared difference over all elements of two vector columns."""
    return pairs.agg(
        (F.sum(V.squared_l2(a, b)) / F.sum(F.size(a))).alias("mse"),
    )
