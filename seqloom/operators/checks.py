"""Input checks that fail early: columns, alignment, emptiness, parameters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# The columns a tokenized sample must have.
TOKENIZED_COLUMNS = (
    "input_ids",
    "attention_mask",
    "labels",
    "token_slot_ids",
    "token_codebook_ids",
    "seq_lengths",
    "history_item_ids",
    "history_mask",
    "target_item_ids",
    "history_semantic_ids",
    "target_semantic_ids",
)


def require_columns(df: DataFrame, names: Iterable[str] = TOKENIZED_COLUMNS) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


@dataclass(frozen=True)
class VectorShape:
    rows: int
    dim: int
    max_index: int


def vector_shape(vectors: DataFrame) -> VectorShape:
    """Row count, common dimension and largest index; raises when vectors differ in length."""
    s = vectors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size("vec")).alias("low"),
        F.max(F.size("vec")).alias("high"),
        F.max("item_idx").alias("top"),
    ).first()
    if s["rows"] == 0:
        raise ValueError("no vectors")
    if s["low"] != s["high"]:
        raise ValueError(f"vectors differ in dimension: {s['low']} to {s['high']}")
    return VectorShape(s["rows"], s["high"], s["top"])


def require_same_items(sources: dict[str, DataFrame]) -> None:
    """Every source must hold exactly one vector for the items of the first one."""
    (first, base), *others = sources.items()
    size = base.count()
    for name, df in others:
        if df.count() != size or not base.join(df, "item_idx", "left_anti").isEmpty():
            raise ValueError(f"sources {first!r} and {name!r} do not cover the same items")


def require_catalogue(vectors: DataFrame, item_map: DataFrame) -> DataFrame:
    """Vectors must exist for exactly the items of the catalogue."""
    expected, found = item_map.count(), vectors.count()
    if found != expected:
        raise ValueError(f"{found} vectors for {expected} catalogue items")
    return require_all_items(vectors, item_map)


def require_all_items(table: DataFrame, item_map: DataFrame, key: str = "item_idx") -> DataFrame:
    """Every catalogue item must occur in ``table``."""
    missing = item_map.join(table, key, "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"catalogue items without an entry, for example {missing.first()[key]!r}")
    return table


def require_covers(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """Vectors must reach the largest item index used by histories and targets."""
    top = samples.agg(
        F.greatest(F.max("target"), F.max(F.array_max("history"))).alias("top")
    ).first()["top"]
    if top is not None and vector_shape(vectors).rows < top + 1:
        raise ValueError(f"samples use item index {top}, beyond the vector table")
    return vectors


def require_divisible(dim: int, parts: int) -> int:
    if parts < 1 or dim % parts:
        raise ValueError(f"dimension {dim} is not a multiple of {parts} subspaces")
    return dim // parts


def parse_topk(value: str | Iterable[int]) -> list[int]:
    """'5,10,20' -> [5, 10, 20]: sorted, unique, positive."""
    parts = [p for p in value.split(",") if p.strip()] if isinstance(value, str) else value
    ks = sorted({int(p) for p in parts})
    if not ks or ks[0] < 1:
        raise ValueError(f"top-k values must be positive integers, got {value!r}")
    return ks
