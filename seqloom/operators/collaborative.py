"""Item vectors from behaviour: SPPMI with low rank, skip-gram, and matrix factorization."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from seqloom.functions import vector as V
from seqloom.operators.cooccurrence import cooccurrence, skipgram_pairs, sppmi
from seqloom.operators.gridtrain import Training, train_factors
from seqloom.operators.sampling import gaussian
from seqloom.session import materialize

# Method names.
METHODS = ("item_item_sppmi", "item2vec", "mf_bpr")
OVERSAMPLE, POWER_STEPS = 8, 2  # fixed values of the randomized projection


def sppmi_vectors(
    positions: DataFrame, item_map: DataFrame, dim: int = 128, window: int = 5, shift: float = 1.0, seed: int = 0
) -> DataFrame:
    """(item_idx, vec): rows of the shifted PPMI matrix reduced to ``dim`` and normalised."""
    cells = materialize(cooccurrence(positions, window), "cooccurrence")
    if cells.isEmpty():
        raise ValueError("no item pairs within the window")
    sparse = materialize(sppmi(cells, shift), "sppmi")
    return project_sparse(sparse, item_map, dim, seed)


def project_sparse(cells: DataFrame, item_map: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Unit vectors from sparse rows (item_i, item_j, sppmi) of a square matrix.

    Up to ``dim`` items the rows are only zero-padded. Beyond, the centred rows are projected
    on their main axes by randomized subspace iteration; the wide matrix stays sparse and only
    small square matrices reach the driver.
    """
    n_items = item_map.count()
    cells = cells.filter(F.col("sppmi") > 0)
    if n_items <= dim:
        rows = cells.groupBy("item_i").agg(F.map_from_entries(F.collect_list(F.struct("item_j", "sppmi"))).alias("m"))
        places = F.sequence(F.lit(0), F.lit(dim - 1))
        dense = item_map.select(F.col("item_idx").alias("item_i")).join(rows, "item_i", "left").select(
            F.col("item_i").alias("item_idx"),
            F.transform(places, lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("vec"),
        )
        return dense.select("item_idx", V.l2_normalize("vec").alias("vec"))
    width = min(dim + OVERSAMPLE, n_items)
    ids = item_map.select("item_idx")
    means = cells.groupBy("item_j").agg((F.sum("sppmi") / F.lit(float(n_items))).alias("mu"))
    turned = cells.select(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"), "sppmi")
    start = ids.select(
        "item_idx",
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: gaussian(seed, F.col("item_idx"), d)).alias("vec"),
    )
    basis = _orthonormal(_times(cells, start, ids, means, centre_rows=True))
    for _ in range(POWER_STEPS):
        basis = _orthonormal(_times(turned, basis, ids, means, centre_rows=False))
        basis = _orthonormal(_times(cells, basis, ids, means, centre_rows=True))
    small = materialize(_times(turned, basis, ids, means, centre_rows=False), "projected")
    values, axes = np.linalg.eigh(_gram(small))
    order = np.argsort(values)[::-1][: min(dim, n_items)]
    # Centred rows times the right axes equal basis * axes * singular values.
    scaled = axes[:, order] * np.sqrt(np.maximum(values[order], 0.0))
    reduced = _right_multiply(basis, scaled)
    padded = reduced.select("item_idx", V.zero_pad("vec", dim).alias("vec"))
    return padded.select("item_idx", V.l2_normalize("vec").alias("vec"))


def _weighted_sums(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """(item_idx, vec): sum over j of cell(i, j) * vec(j), combined before the shuffle."""
    features = vectors.select(F.col("item_idx").alias("item_j"), array_to_vector("vec").alias("_f"))
    return cells.join(features, "item_j").groupBy(F.col("item_i").alias("item_idx")).agg(
        vector_to_array(Summarizer.sum(F.col("_f"), F.col("sppmi"))).alias("vec")
    )


def _times(cells, vectors, ids, means, centre_rows: bool) -> DataFrame:
    """Centred matrix (or its transpose) times a tall thin matrix given by rows."""
    product = _weighted_sums(cells, vectors)
    width = F.size("vec")
    full = ids.join(product, "item_idx", "left")
    joined = vectors.join(means.withColumnRenamed("item_j", "item_idx"), "item_idx", "left")
    mu = F.coalesce("mu", F.lit(0.0))
    weight = mu if centre_rows else F.lit(1.0)
    features = array_to_vector("vec")
    shift = np.array(joined.agg(vector_to_array(Summarizer.sum(features, weight)).alias("s")).first()["s"])
    minus = F.array(*[F.lit(float(x)) for x in shift])
    zero = F.array_repeat(F.lit(0.0), len(shift))
    value = F.coalesce("vec", zero)
    if centre_rows:  # every row loses the mean row times the vectors
        out = full.select("item_idx", F.zip_with(value, minus, lambda a, b: a - b).alias("vec"))
    else:  # column j loses mu_j times the column sums of the vectors
        with_mu = full.join(means.withColumnRenamed("item_j", "item_idx"), "item_idx", "left")
        out = with_mu.select("item_idx", F.zip_with(value, F.transform(minus, lambda b: b * mu), lambda a, b: a - b).alias("vec"))
    return materialize(out, "times")


def _gram(rows: DataFrame) -> np.ndarray:
    """Sum of outer products: one small square matrix per task, added up."""
    import pyarrow as pa

    from seqloom.operators.gather import as_lists, as_matrix

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column("vec"))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            place = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([place, as_lists(total)], ["row", "vec"])

    partial = rows.select("vec").mapInArrow(run, "row int, vec array<double>")
    sums = partial.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
    return np.array([r["vec"] for r in sums.orderBy("row").collect()])


def _right_multiply(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    from seqloom.operators.quantize import _map_vectors

    return _map_vectors(rows, lambda x: x @ matrix)


def _orthonormal(rows: DataFrame) -> DataFrame:
    """Columns made orthonormal through the small Gram matrix."""
    values, axes = np.linalg.eigh(_gram(rows))
    keep = values > max(values.max(), 0.0) * 1e-12
    return materialize(_right_multiply(rows, axes[:, keep] / np.sqrt(values[keep])), "basis")


def item2vec_vectors(
    positions: DataFrame,
    item_map: DataFrame,
    dim: int = 128,
    window: int = 5,
    epochs: int = 5,
    negatives: int = 10,
    seed: int = 0,
    rate: float = 0.1,
    batch: int = 256,
    blocks: int | None = None,
) -> DataFrame:
    """(item_idx, vec): skip-gram vectors of all items, normalised.

    All pairs up to ``window`` positions apart train; contexts are told from ``negatives`` items drawn
    by their counts to the power 3/4. Items without a pair keep their initial direction.
    """
    pairs = skipgram_pairs(positions, window).groupBy(F.col("center").alias("left"), F.col("context").alias("right"))
    pairs = materialize(pairs.agg(F.count(F.lit(1)).alias("n")), "skipgram-pairs")
    if pairs.isEmpty():
        raise ValueError("no item pairs within the window")
    counts = pairs.groupBy(F.col("right").alias("item_idx")).agg(F.sum("n").alias("n"))
    mass = F.pow(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("double"), 0.75)
    ids = item_map.select("item_idx").join(counts, "item_idx", "left").select(F.col("item_idx").alias("id"), mass.alias("mass"))
    training = Training("skipgram", dim, epochs, max(1, negatives), rate, 0.0, batch, seed, blocks)
    found, _ = train_factors(pairs, ids.select("id"), ids, training)
    return _unit_rows(found)


def _unit_rows(factors: DataFrame) -> DataFrame:
    return factors.select(F.col("id").cast("int").alias("item_idx"), V.l2_normalize("vec").alias("vec"))


def _whole_catalogue(found: DataFrame, item_map: DataFrame, dim: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), dim)
    full = item_map.select("item_idx").join(found, "item_idx", "left").select("item_idx", F.coalesce("vec", zero).alias("vec"))
    return full.select("item_idx", V.l2_normalize("vec").alias("vec"))


def als_vectors(indexed: DataFrame, item_map: DataFrame, dim: int = 128, epochs: int = 5, reg: float = 1e-2, seed: int = 0) -> DataFrame:
    """(item_idx, vec): item factors of implicit-feedback matrix factorization, normalised."""
    counts = indexed.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).cast("float").alias("rating"))
    model = ALS(
        rank=dim, maxIter=epochs, regParam=reg, implicitPrefs=True, seed=seed,
        userCol="user_idx", itemCol="item_idx", ratingCol="rating",
    ).fit(counts)
    found = model.itemFactors.select(F.col("id").alias("item_idx"), F.col("features").cast("array<double>").alias("vec"))
    return _whole_catalogue(found, item_map, dim)


def bpr_vectors(
    indexed: DataFrame,
    item_map: DataFrame,
    dim: int = 128,
    epochs: int = 5,
    negatives: int = 1,
    rate: float = 0.1,
    reg: float = 1e-4,
    seed: int = 0,
    batch: int = 256,
    blocks: int | None = None,
) -> DataFrame:
    """(item_idx, vec): item factors trained on the pairwise ranking loss, normalised.

    Every interaction is visited once an epoch, repeated ones as often as they occur, each time with
    ``negatives`` items that the user lacks. Users who own a whole block of items have none in it.
    """
    pairs = indexed.groupBy(F.col("user_idx").alias("left"), F.col("item_idx").alias("right")).agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs, "owned-pairs")
    users = pairs.select(F.col("left").alias("id")).distinct()
    items = item_map.select(F.col("item_idx").alias("id"), F.lit(1.0).alias("mass"))
    training = Training("ranking", dim, epochs, max(1, negatives), rate, reg, batch, seed, blocks)
    _, found = train_factors(pairs, users, items, training)
    return _unit_rows(found)


def collaborative_vectors(method: str, positions: DataFrame, item_map: DataFrame, dim: int = 128, **options) -> DataFrame:
    """Vectors by method name; unknown names are an error."""
    if method == "item_item_sppmi":
        return sppmi_vectors(positions, item_map, dim, **options)
    if method == "item2vec":
        return item2vec_vectors(positions, item_map, dim, **options)
    if method == "mf_bpr":
        return bpr_vectors(positions, item_map, dim, **options)
    raise ValueError(f"unknown method {method!r}; expected one of {METHODS}")
