"""Retrieval evaluation end to end: score, exclude, penalise, rank, measure per group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seqloom.functions import vector as V
from seqloom.operators.codes import TokenLayout, encode_code
from seqloom.operators.gather import pool_history
from seqloom.operators.losses import log_softmax_arrays
from seqloom.operators.popularity import popularity_groups, popularity_penalty, target_frequency
from seqloom.operators.retrieval import grouped_metrics, rank_catalogue
from seqloom.session import materialize, spread


@dataclass(frozen=True)
class Evaluation:
    ranked: DataFrame
    groups: DataFrame
    metrics: DataFrame


def pooled_queries(samples: DataFrame, vectors: DataFrame, key: list[str], normalize: bool = False) -> DataFrame:
    """Baseline scorer: the mean vector of the history. Samples are dealt evenly while they are narrow."""
    pooled = pool_history(spread(samples), vectors, key).withColumnRenamed("pooled", "vec")
    return pooled.withColumn("vec", V.l2_normalize("vec")) if normalize else pooled


def code_queries(samples: DataFrame) -> DataFrame:
    """Query vectors for code scoring: log-softmax of ``logits`` (one array per code position)."""
    return log_softmax_arrays(samples, "logits", "vec").drop("logits")


def code_items(codes: DataFrame, layout: TokenLayout) -> DataFrame:
    """Item vectors for code scoring: places of the item's tokens in the query vector."""
    places = F.transform(encode_code("code", layout), lambda token, c: token + c * layout.vocab_size)
    return codes.select("item_idx", places.alias("vec"))


def evaluate(
    queries: DataFrame,
    items: DataFrame,
    train: DataFrame,
    key: list[str],
    topk: str = "5,10,20",
    strategy: str = "equal_items",
    penalty_weight: float = 0.0,
    exclude_history: bool = True,
    score: str = "dot",
    held: int | None = None,
) -> Evaluation:
    """Rank the catalogue for every query and measure overall and by target popularity.

    ``train`` holds the samples whose targets define item frequency. ``held``: best items kept for
    every query, by default as many as the largest of ``topk``; the metrics need none of them.
    """
    frequency = target_frequency(train, items)
    if penalty_weight:
        items = items.join(popularity_penalty(frequency), "item_idx")
    k = max(int(p) for p in topk.split(",")) if held is None else held
    ranked = materialize(
        rank_catalogue(queries, items, key, k, score, exclude_history, penalty_weight),
        "ranked",
    )
    groups = popularity_groups(frequency, strategy)
    return Evaluation(ranked, groups, grouped_metrics(ranked, groups, topk))
