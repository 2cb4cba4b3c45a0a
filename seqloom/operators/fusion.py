"""Fusing aligned item vectors from several sources, and reducing their dimension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import vector as V
from seqloom.operators.checks import require_same_items, vector_shape

Sources = dict[str, DataFrame]


def join_sources(sources: Sources) -> tuple[DataFrame, list[Column]]:
    """One row per item with the vector of every source, in argument order."""
    if not sources:
        raise ValueError("no embedding sources")
    named = [
        df.select("item_idx", F.col("vec").alias(f"_v{i}")) for i, df in enumerate(sources.values())
    ]
    joined = reduce(lambda a, b: a.join(b, "item_idx"), named)
    return joined, [F.col(f"_v{i}") for i in range(len(named))]


def _unit(col: Column, wanted: bool) -> Column:
    return V.l2_normalize(col) if wanted else col.cast("array<double>")


def fuse_weighted(
    sources: Sources,
    weights: dict[str, float],
    normalize_each: bool = True,
    normalize_output: bool = True,
) -> DataFrame:
    """Weighted mean of the sources; a source without weight counts 0."""
    total = float(sum(weights.get(name, 0.0) for name in sources))
    if total <= 0:
        raise ValueError("the source weights must have a positive sum")
    joined, cols = join_sources(sources)
    parts = [
        V.scale(_unit(col, normalize_each), F.lit(float(weights.get(name, 0.0))))
        for name, col in zip(sources, cols)
    ]
    # The sum is a column of its own, so that normalising does not repeat the fusion.
    fused = joined.select("item_idx", V.scale(V.add(*parts), F.lit(1.0 / total)).alias("vec"))
    return fused.select("item_idx", _unit(F.col("vec"), normalize_output).alias("vec"))


def fuse_mean(
    sources: Sources,
    weights: dict[str, float] | None = None,
    normalize_each: bool = True,
    normalize_output: bool = True,
) -> DataFrame:
    """Plain mean of the sources; weights are ignored."""
    return fuse_weighted(sources, {s: 1.0 for s in sources}, normalize_each, normalize_output)


def fuse_concat(
    sources: Sources,
    weights: dict[str, float] | None = None,
    normalize_each: bool = True,
    normalize_output: bool = False,
) -> DataFrame:
    """Vectors side by side in argument order; weights are ignored."""
    joined, cols = join_sources(sources)
    side_by_side = F.concat(*[_unit(col, normalize_each) for col in cols])
    fused = joined.select("item_idx", side_by_side.alias("vec"))
    return fused.select("item_idx", _unit(F.col("vec"), normalize_output).alias("vec"))


FUSIONS: dict[str, Callable[..., DataFrame]] = {
    "weighted_sum": fuse_weighted,
    "mean": fuse_mean,
    "concat": fuse_concat,
}


def fuse(
    sources: Sources,
    strategy: str = "weighted_sum",
    weights: dict[str, float] | None = None,
    normalize_each: bool = True,
    normalize_output: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Fuse by strategy name after checking that all sources cover the same items."""
    if strategy not in FUSIONS:
        raise ValueError(f"unknown fusion strategy {strategy!r}; expected one of {sorted(FUSIONS)}")
    if validate:
        require_same_items(sources)
        if strategy != "concat":
            dims = {name: vector_shape(df).dim for name, df in sources.items()}
            if len(set(dims.values())) > 1:
                raise ValueError(f"sources differ in dimension: {dims}")
    if weights is None:
        weights = {name: 1.0 for name in sources}
    return FUSIONS[strategy](sources, weights, normalize_each, normalize_output)


def center(vectors: DataFrame) -> DataFrame:
    """Subtract the mean vector; adds the ``features`` vector column."""
    featured = vectors.select("item_idx", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False)
    return scaler.fit(featured).transform(featured).select("item_idx", "features")


def reduce_dim(vectors: DataFrame, dim: int = 128) -> DataFrame:
    """Unit vectors of exactly ``dim`` elements: zero-padded, or projected on the main axes."""
    shape = vector_shape(vectors)
    if shape.dim <= dim:
        padded = vectors.select("item_idx", V.zero_pad("vec", dim).alias("vec"))
        return padded.select("item_idx", V.l2_normalize("vec").alias("vec"))
    axes = min(dim, shape.rows)
    model_in = center(vectors).persist()
    model = PCA(k=axes, inputCol="features", outputCol="reduced").fit(model_in)
    model_in.unpersist()
    reduced = model.transform(center(vectors)).select(
        "item_idx", V.zero_pad(vector_to_array("reduced"), dim).alias("vec")
    )
    return reduced.select("item_idx", V.l2_normalize("vec").alias("vec"))
