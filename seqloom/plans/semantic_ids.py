"""From item vectors to codes and tokenized samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from seqloom.operators.checks import require_catalogue
from seqloom.operators.codes import TokenLayout, infer_layout, tokenize_samples
from seqloom.operators.fusion import Sources, fuse
from seqloom.operators.quantize import Quantized, quantize
from seqloom.session import materialize


@dataclass(frozen=True)
class SemanticIds:
    """Codes with item ids, their token layout, and the quantizer's other results."""

    codes: DataFrame
    layout: TokenLayout
    quantized: Quantized

    def tokenize(self, samples: DataFrame, history_len: int) -> DataFrame:
        return tokenize_samples(samples, self.codes, self.layout, history_len)


def build_semantic_ids(
    sources: Sources,
    item_map: DataFrame,
    strategy: str = "weighted_sum",
    weights: dict[str, float] | None = None,
    method: str = "pq",
    **options,
) -> SemanticIds:
    """Fuse the sources, check them against the catalogue, quantize, and derive the layout.

    ``options`` go to ``quantize``.
    """
    fused = materialize(fuse(sources, strategy, weights), "fused")
    quantized = quantize(require_catalogue(fused, item_map), method, **options)
    named = quantized.codes.join(item_map.select("item_idx", "item_id"), "item_idx")
    codes = materialize(named.select("item_idx", "item_id", "code"), "item-codes")
    return SemanticIds(codes, infer_layout(codes), quantized)
