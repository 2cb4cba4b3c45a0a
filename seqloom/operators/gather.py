"""Looking up item vectors for histories and targets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.functions import vector as V
from seqloom.operators.checks import vector_shape

MAX_BROADCAST_BYTES = 64 << 20
MAX_POOL_BYTES = 256 << 20  # of vectors that travel with the tasks that pool them


def as_matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return np.zeros((0, 0), dtype)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(array), -1)


def as_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a 2-D array as a list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _valid_steps(samples: DataFrame, key: list[str]) -> DataFrame:
    """(key, step, item_idx) for history entries that are unmasked and not padding."""
    steps = F.arrays_zip(F.col("history").alias("item_idx"), F.col("mask").alias("ok"))
    return (
        samples.select(*key, F.posexplode(steps).alias("step", "e"))
        .select(*key, "step", F.col("e.item_idx").alias("item_idx"), F.col("e.ok").alias("ok"))
        .filter(F.col("ok") & (F.col("item_idx") >= 0))
        .drop("ok")
    )


def item_names(samples: DataFrame, item_map: DataFrame, key: list[str], column: str = "history_items") -> DataFrame:
    """Add the item ids of the valid history entries, in order."""
    named = _valid_steps(samples, key).join(item_map.select("item_idx", "item_id"), "item_idx")
    listed = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("step", "item_id"))).alias("_n"))
    names = F.coalesce(F.col("_n.item_id"), F.array().cast("array<string>"))
    return samples.join(listed, key, "left").select(*samples.columns, names.alias(column))


def gather_history(samples: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Add ``history_vecs``: one vector per history slot, zeros for padding and missing items.

    Each sample brings at most its history length of rows to the regrouping.
    """
    dim = vector_shape(vectors).dim
    zero = F.array_repeat(F.lit(0.0), dim)
    found = (
        _valid_steps(samples, key)
        .join(vectors.select("item_idx", F.col("vec").cast("array<double>").alias("vec")), "item_idx")
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("step", "vec"))).alias("_by_step"))
    )
    slots = F.sequence(F.lit(0), F.size("history") - 1)
    looked_up = F.transform(slots, lambda s: F.coalesce(F.try_element_at("_by_step", s), zero))
    return samples.join(found, key, "left").select(*samples.columns, looked_up.alias("history_vecs"))


def gather_target(
    samples: DataFrame, vectors: DataFrame, target: str = "target", normalize: bool = False
) -> DataFrame:
    """Add ``target_vec``; zeros for a negative or unknown target."""
    dim = vector_shape(vectors).dim
    wanted = vectors.select(F.col("item_idx").alias(target), F.col("vec").alias("_vec"))
    vec = F.coalesce(F.col("_vec").cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
    return samples.join(wanted, target, "left").select(
        *samples.columns, (V.l2_normalize(vec) if normalize else vec).alias("target_vec")
    )


def pool_history(
    samples: DataFrame,
    vectors: DataFrame,
    key: list[str],
    max_broadcast_bytes: int = MAX_POOL_BYTES,
) -> DataFrame:
    """Add ``pooled``: the mean vector of the valid history items, zeros when there are none.

    Vector tables of a checked small size are shipped to the tasks and gathered per Arrow
    batch; larger ones are joined by item and averaged per sample.
    """
    shape = vector_shape(vectors)
    kind = np.float32 if vectors.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
    if (shape.max_index + 1) * shape.dim * np.dtype(kind).itemsize <= max_broadcast_bytes:
        return _pool_in_batches(samples, vectors, shape.max_index + 1, shape.dim, kind)
    return _pool_by_join(samples, vectors, key, shape.dim)


def _pool_in_batches(samples: DataFrame, vectors: DataFrame, rows: int, dim: int, kind: type = np.float64) -> DataFrame:
    held = vectors.select("item_idx", "vec").toArrow()
    table = np.zeros((rows + 1, dim), kind)  # the last row answers padding and unknown items
    known = np.zeros(rows + 1)
    index = held["item_idx"].to_numpy()
    table[index], known[index] = as_matrix(held["vec"], kind), 1.0
    shared = samples.sparkSession.sparkContext.broadcast((table, known))

    def pool(batches):
        matrix, present = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            items = as_matrix(batch.column("history"), np.int64)
            ok = as_matrix(batch.column("mask"), np.bool_)
            items = np.where(ok & (items >= 0) & (items < rows), items, rows)
            sums = np.zeros((len(items), matrix.shape[1]))
            for step in range(items.shape[1]):  # one gather per history slot
                sums += matrix[items[:, step]]
            counts = present[items].sum(axis=1, keepdims=True)
            means = sums / np.maximum(counts, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, as_lists(means)], [*batch.schema.names, "pooled"]
            )

    schema = samples.withColumn("pooled", F.array(F.lit(0.0))).schema
    return samples.mapInArrow(pool, schema)


def _pool_by_join(samples: DataFrame, vectors: DataFrame, key: list[str], dim: int) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    features = vectors.select(
        "item_idx", array_to_vector(F.col("vec").cast("array<double>")).alias("_f")
    )
    means = (
        _valid_steps(samples, key)
        .join(features, "item_idx")
        .groupBy(*key)
        .agg(vector_to_array(Summarizer.mean(F.col("_f"))).alias("_mean"))
    )
    pooled = F.coalesce("_mean", F.array_repeat(F.lit(0.0), dim))
    return samples.join(means, key, "left").select(*samples.columns, pooled.alias("pooled"))


def masked_mean(tokens: DataFrame, key: list[str], vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Mean of the token vectors with mask 1 per key: sum(mask * vec) / max(sum(mask), 1)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    weight = F.col(mask).cast("double")
    keys = tokens.groupBy(*key).agg(F.max(F.size(vec)).alias("_dim"))
    summed = (
        tokens.filter(weight > 0)
        .groupBy(*key)
        .agg(
            vector_to_array(
                Summarizer.sum(array_to_vector(F.col(vec).cast("array<double>")), weight)
            ).alias("_sum"),
            F.sum(weight).alias("_n"),
        )
    )
    mean = F.coalesce(
        V.scale("_sum", 1.0 / F.greatest("_n", F.lit(1.0))), F.array_repeat(F.lit(0.0), F.col("_dim"))
    )
    return keys.join(summed, key, "left").select(*key, mean.alias("pooled"))
