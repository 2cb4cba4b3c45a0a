"""Vector quantizers: k-means, product, rotated product and recursive k-means codes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import vector as V
from seqloom.operators.checks import require_divisible, vector_shape
from seqloom.operators.fusion import center
from seqloom.operators.gather import as_lists, as_matrix
from seqloom.operators.retrieval import rank_catalogue
from seqloom.session import materialize

MAX_CODEBOOK_BYTES = 64 << 20
CODEBOOK_SCHEMA = "subspace int, centroid_id int, vec array<double>"
METHODS = ("pq", "opq", "rkmeans")
_CELLS = 1 << 22


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid; ties go to the lowest index."""
    best = np.zeros(len(points), np.int32)
    dist = np.zeros(len(points))
    step = max(1, _CELLS // max(1, len(centroids)))
    weight = (centroids**2).sum(1)
    for start in range(0, len(points), step):
        x = points[start : start + step]
        d = (x**2).sum(1)[:, None] + weight[None, :] - 2.0 * (x @ centroids.T)
        d = np.where(np.isfinite(d), np.maximum(np.round(d, 10), 0.0), np.inf)
        best[start : start + step] = d.argmin(axis=1)
        dist[start : start + step] = d[np.arange(len(x)), best[start : start + step]]
    return best, dist


# ---------------------------------------------------------------- k-means


def fit_kmeans(vectors: DataFrame, k: int, iterations: int = 25, seed: int = 0) -> DataFrame:
    """(centroid_id, vec): Lloyd's algorithm, spread seeding."""
    rows = vectors.count()
    if rows < k:
        raise ValueError(f"{k} clusters need at least {k} rows, got {rows}")
    features = vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")).persist()
    try:
        model = KMeans(k=k, maxIter=max(1, iterations), seed=seed, tol=0.0).fit(features)
    finally:
        features.unpersist()
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centers, "centroid_id int, vec array<double>")


def assign_clusters(vectors: DataFrame, centroids: DataFrame, max_bytes: int = MAX_CODEBOOK_BYTES) -> DataFrame:
    """(item_idx, centroid_id, distance): nearest centroid by final centroids."""
    one = centroids.select(F.lit(0).alias("subspace"), "centroid_id", "vec")
    coded = encode_product(vectors, one, max_bytes)
    return coded.select(
        "item_idx", F.col("code")[0].alias("centroid_id"), F.col("distances")[0].alias("distance")
    )


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance").alias("inertia"))


# ---------------------------------------------------------------- product codes


def fit_product(vectors: DataFrame, subspaces: int = 4, k: int = 256, iterations: int = 25, seed: int = 0) -> DataFrame:
    """Codebooks (subspace, centroid_id, vec), one k-means per slice of the vectors."""
    dim = vector_shape(vectors).dim
    require_divisible(dim, subspaces)
    books = []
    for part in range(subspaces):
        sliced = vectors.select("item_idx", V.subvector("vec", part, subspaces, dim).alias("vec"))
        fitted = fit_kmeans(sliced, k, iterations, seed + part)
        books.append(fitted.select(F.lit(part).alias("subspace"), "centroid_id", "vec"))
    joined = books[0]
    for book in books[1:]:
        joined = joined.unionByName(book)
    return joined


def _load_codebooks(codebooks: DataFrame) -> list[np.ndarray]:
    rows = codebooks.select("subspace", "centroid_id", "vec").toArrow().sort_by(
        [("subspace", "ascending"), ("centroid_id", "ascending")]
    )
    parts = rows["subspace"].to_numpy()
    cuts = np.searchsorted(parts, np.arange(parts.max() + 2))
    return [as_matrix(rows["vec"].slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def _codebook_bytes(codebooks: DataFrame) -> int:
    return codebooks.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0] * 8


def encode_product(vectors: DataFrame, codebooks: DataFrame, max_bytes: int = MAX_CODEBOOK_BYTES) -> DataFrame:
    """(item_idx, code, distances): nearest centroid of every slice.

    Codebooks of a checked small size travel with the tasks; larger ones are searched in
    blocks against blocks of vectors.
    """
    if _codebook_bytes(codebooks) > max_bytes:
        return _encode_in_blocks(vectors, codebooks)
    books = _load_codebooks(codebooks)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points = as_matrix(batch.column("vec"))
            codes, dists, start = [], [], 0
            for book in shared.value:
                code, dist = nearest(points[:, start : start + book.shape[1]], book)
                codes.append(code)
                dists.append(dist)
                start += book.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_idx"), as_lists(np.stack(codes, 1)), as_lists(np.stack(dists, 1))],
                ["item_idx", "code", "distances"],
            )

    return vectors.select("item_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        encode, "item_idx int, code array<int>, distances array<double>"
    )


def _encode_in_blocks(vectors: DataFrame, codebooks: DataFrame) -> DataFrame:
    parts = codebooks.agg(F.max("subspace") + 1).first()[0]
    dim = vector_shape(vectors).dim
    found = None
    for part in range(parts):
        book = codebooks.filter(F.col("subspace") == part).select(F.col("centroid_id").alias("item_idx"), "vec")
        asked = vectors.select(
            F.col("item_idx").alias("_id"),
            V.subvector("vec", part, parts, dim).alias("vec"),
            F.lit(None).cast("int").alias("target"),
        )
        best = rank_catalogue(asked, book, ["_id"], k=1, score="neg_l2", exclude_history=False)
        one = best.select(
            F.col("_id").alias("item_idx"),
            F.lit(part).alias("part"),
            F.col("top")[0]["item_idx"].alias("c"),
            F.greatest(-F.col("top")[0]["score"], F.lit(0.0)).alias("d"),
        )
        found = one if found is None else found.unionByName(one)
    lists = F.sort_array(F.collect_list(F.struct("part", "c", "d")))
    return found.groupBy("item_idx").agg(lists.alias("l")).select(
        "item_idx", F.col("l.c").alias("code"), F.col("l.d").alias("distances")
    )


def decode_product(codes: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(item_idx, vec): centroids of the code side by side."""
    steps = codes.select("item_idx", F.posexplode("code").alias("subspace", "centroid_id"))
    pieces = steps.join(codebooks, ["subspace", "centroid_id"]).groupBy("item_idx").agg(
        F.sort_array(F.collect_list(F.struct("subspace", "vec"))).alias("p")
    )
    return pieces.select("item_idx", F.flatten("p.vec").alias("vec"))


def reconstruction_mse(vectors: DataFrame, decoded: DataFrame) -> DataFrame:
    """Mean squared difference over all elements."""
    pairs = vectors.join(decoded.select("item_idx", F.col("vec").alias("back")), "item_idx")
    return pairs.agg((F.sum(V.squared_l2("vec", "back")) / F.sum(F.size("vec"))).alias("mse"))


# ---------------------------------------------------------------- rotated product codes


@dataclass(frozen=True)
class Rotation:
    """Mean and orthogonal axes (columns) learned from the vectors; D x D, driver-sized."""

    mean: np.ndarray
    axes: np.ndarray

    def apply(self, vectors: DataFrame) -> DataFrame:
        mean, axes = self.mean, self.axes
        return _map_vectors(vectors, lambda x: (x - mean) @ axes)

    def undo(self, vectors: DataFrame) -> DataFrame:
        mean, axes = self.mean, self.axes
        return _map_vectors(vectors, lambda x: x @ axes.T + mean)


def _map_vectors(vectors: DataFrame, fn) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = as_lists(fn(as_matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays([batch.column("item_idx"), out], ["item_idx", "vec"])

    return vectors.select("item_idx", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(
        run, "item_idx int, vec array<double>"
    )


def fit_rotation(vectors: DataFrame) -> Rotation:
    shape = vector_shape(vectors)
    if shape.rows < shape.dim:
        raise ValueError(f"a rotation of dimension {shape.dim} needs as many rows, got {shape.rows}")
    features = array_to_vector(F.col("vec").cast("array<double>"))
    mean = vectors.agg(Summarizer.mean(features).alias("m")).first()["m"].toArray()
    model = PCA(k=shape.dim, inputCol="features", outputCol="reduced").fit(center(vectors))
    return Rotation(mean, model.pc.toArray())


# ---------------------------------------------------------------- recursive k-means


@dataclass
class CodeTree:
    """Centroid of every known code prefix: (prefix, vec)."""

    nodes: DataFrame
    levels: int
    dim: int


MAX_CENTER_BYTES = 64 << 20


def fit_tree(
    vectors: DataFrame,
    levels: int = 4,
    branching: int = 16,
    iterations: int = 25,
    seed: int = 0,
    max_center_bytes: int = MAX_CENTER_BYTES,
) -> tuple[DataFrame, CodeTree]:
    """Split every bucket into at most ``branching`` clusters, level by level.

    Returns (item_idx, code) and the tree. All buckets of a level are clustered together over all
    tasks, whatever their sizes: rows are dealt out by ranges of (bucket, item), so a large bucket is
    cut over many tasks and a task holds neighbouring small ones; what leaves a task is one summary a
    bucket. Levels of very many buckets go in waves whose centers stay below ``max_center_bytes``.
    """
    if levels < 1:
        raise ValueError("levels must be positive")
    dim = vector_shape(vectors).dim
    state = vectors.select(
        "item_idx", F.col("vec").cast("array<double>").alias("vec"), F.array().cast("array<int>").alias("code")
    )
    nodes = None
    for level in range(levels):
        named = state.withColumn("bucket", F.array_join(F.col("code").cast("array<string>"), "-"))
        dealt = materialize(named.repartitionByRange("bucket", "item_idx").sortWithinPartitions("bucket"), f"tree-level-{level}")
        buckets = dealt.select("bucket").distinct().count()
        waves = max(1, -(-buckets * branching * dim * 8 // max_center_bytes))
        parts = None
        for wave in range(waves):
            chosen = dealt if waves == 1 else dealt.filter(F.pmod(F.xxhash64("bucket"), F.lit(waves)) == wave)
            split = _split_buckets(chosen, branching, iterations, seed + level)
            parts = split if parts is None else parts.unionByName(split)
        parts = materialize(parts, f"tree-split-{level}")
        state = parts.select("item_idx", "vec", F.concat("code", F.array("label")).alias("code"))
        centers = parts.groupBy(F.concat("code", F.array("label")).alias("prefix")).agg(
            F.first("center").alias("vec")
        )
        nodes = centers if nodes is None else nodes.unionByName(centers)
    return state.select("item_idx", "code"), CodeTree(nodes, levels, dim)


_SPLIT_SCHEMA = "item_idx int, vec array<double>, code array<int>, label int, center array<double>"


def _means(x: np.ndarray, label: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros_like(centers)
    np.add.at(sums, label, x)
    return sums, np.bincount(label, minlength=len(centers))


def _split_buckets(rows: DataFrame, branching: int, iterations: int, seed: int) -> DataFrame:
    """k-means of many buckets at once; only centers and per-task sums leave the tasks.

    Seeding draws by squared distance: the row with the largest ln(u)/d² of a hash uniform u
    is exactly such a draw, and finding it is one aggregate over all buckets. An empty cluster keeps
    its center.
    """
    spark = rows.sparkSession
    rows_of = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    centers: dict = dict.fromkeys(rows_of)
    for step in range(min(branching, max(rows_of.values(), default=0))):
        picks = _reduce_batches(rows, centers, _pick_far(_step_seed(seed, step)), "bucket string, weight double, vec array<double>")
        best = picks.groupBy("bucket").agg(F.max_by("vec", "weight").alias("vec")).collect()
        for r in best:
            before = centers[r["bucket"]]
            if step < rows_of[r["bucket"]]:
                centers[r["bucket"]] = np.array([r["vec"]]) if before is None else np.vstack([before, r["vec"]])
    for _ in range(max(1, iterations)):
        sums = _reduce_batches(rows, centers, _partial_sums, "bucket string, label int, n bigint, vec array<double>")
        merged = sums.groupBy("bucket", "label").agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")
        )
        for r in merged.filter("n > 0").collect():
            centers[r["bucket"]][r["label"]] = np.array(r["vec"]) / r["n"]
    shared = spark.sparkContext.broadcast(centers)

    def label_rows(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column("vec"))
            label, center_of = np.zeros(len(x), np.int32), np.zeros_like(x)
            for name, at in _by_bucket(batch):
                label[at], _ = nearest(x[at], shared.value[name])
                center_of[at] = shared.value[name][label[at]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_idx"), batch.column("vec"), batch.column("code"), pa.array(label), as_lists(center_of)],
                ["item_idx", "vec", "code", "label", "center"],
            )

    return rows.select("item_idx", "vec", "code", "bucket").mapInArrow(label_rows, _SPLIT_SCHEMA)


def _by_bucket(batch: pa.RecordBatch):
    """(bucket, its rows of the batch); batches come sorted by bucket."""
    names = batch.column("bucket").dictionary_encode()
    index = names.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(index[1:] != index[:-1]) + 1).tolist(), len(index)]
    for a, b in zip(cuts, cuts[1:]):
        yield names.dictionary[int(index[a])].as_py(), slice(a, b)


def _reduce_batches(keyed: DataFrame, centers: dict, fn, schema: str) -> DataFrame:
    """``fn`` folds the rows of each bucket into a per-task summary, emitted once per task."""
    shared = keyed.sparkSession.sparkContext.broadcast(centers)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        folded: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column("vec"))
            ids = batch.column("item_idx").to_numpy()
            for name, at in _by_bucket(batch):
                folded[name] = fn(ids[at], x[at], shared.value[name], folded.get(name))
        for name, (columns, vecs) in folded.items():
            head = pa.array([name] * len(vecs))
            yield pa.RecordBatch.from_arrays([head, *map(pa.array, columns), as_lists(vecs)], names)

    return keyed.select("item_idx", "vec", "bucket").mapInArrow(run, schema)


def _hash_unit(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniforms in (0, 1) from item ids (64-bit mixing of splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed + 1) % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _step_seed(seed: int, step: int) -> int:
    return seed + 7919 * step


def _far_weight(ids: np.ndarray, dist: np.ndarray, seed: int) -> np.ndarray:
    # Rows on top of a center weigh almost nothing: they win only if all rows do.
    return np.log(_hash_unit(ids, seed)) / np.maximum(dist, 1e-300)


def _pick_far(seed: int):
    """The row drawn by squared distance; while there are no centers, one drawn evenly."""

    def pick(ids, x, centers, before):
        weight = _hash_unit(ids, seed) if centers is None else _far_weight(ids, nearest(x, centers)[1], seed)
        at = int(weight.argmax())
        if before is not None and before[0][0][0] >= weight[at]:
            return before
        return [weight[at : at + 1]], x[at : at + 1]

    return pick


def _partial_sums(ids, x, centers, before):
    label, _ = nearest(x, centers)
    sums, counts = _means(x, label, centers)
    if before is not None:
        counts, sums = counts + before[0][1], sums + before[1]
    return [np.arange(len(centers), dtype=np.int32), counts], sums


def encode_tree(vectors: DataFrame, tree: CodeTree) -> DataFrame:
    """(item_idx, code): walk from the root to the nearest child at every level."""
    children = tree.nodes.select(
        F.slice("prefix", 1, F.size("prefix") - 1).alias("code"),
        F.struct(F.element_at("prefix", -1).alias("label"), F.col("vec").alias("center")).alias("child"),
    ).groupBy("code").agg(F.collect_list("child").alias("children"))
    walked = vectors.select(
        "item_idx", F.col("vec").cast("array<double>").alias("vec"), F.array().cast("array<int>").alias("code")
    )
    for _ in range(tree.levels):
        best = F.array_min(
            F.transform(
                "children",
                lambda c: F.struct(V.squared_l2(F.col("vec"), c["center"]).alias("d"), c["label"].alias("label")),
            )
        )
        walked = walked.join(children, "code", "left").select(
            "item_idx", "vec", F.concat("code", F.array(F.coalesce(best["label"], F.lit(0)))).alias("code")
        )
    return walked.select("item_idx", "code")


def decode_tree(codes: DataFrame, tree: CodeTree) -> DataFrame:
    """(item_idx, vec): centroid of the longest known prefix, zeros when none is known."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("code")), lambda n: F.slice("code", 1, n))
    found = (
        codes.select("item_idx", F.explode(prefixes).alias("prefix"))
        .join(tree.nodes, "prefix")
        .groupBy("item_idx")
        .agg(F.max_by("vec", F.size("prefix")).alias("vec"))
    )
    zero = F.array_repeat(F.lit(0.0), tree.dim)
    return codes.join(found, "item_idx", "left").select("item_idx", F.coalesce("vec", zero).alias("vec"))


# ---------------------------------------------------------------- one call for all methods


@dataclass
class Quantized:
    method: str
    codes: DataFrame
    reconstructed: DataFrame
    mse: float
    model: dict = field(default_factory=dict)


def _quantize_pq(vectors, subspaces, codebook_size, iterations, seed, **_):
    books = materialize(fit_product(vectors, subspaces, codebook_size, iterations, seed), "codebooks")
    codes = encode_product(vectors, books).select("item_idx", "code")
    return codes, decode_product(codes, books), {"codebooks": books}


def _quantize_opq(vectors, subspaces, codebook_size, iterations, seed, **_):
    rotation = fit_rotation(vectors)
    rotated = materialize(rotation.apply(vectors), "rotated")
    codes, decoded, model = _quantize_pq(rotated, subspaces, codebook_size, iterations, seed)
    return codes, rotation.undo(decoded), {**model, "rotation": rotation}


def _quantize_tree(vectors, levels, branching, iterations, seed, **_):
    codes, tree = fit_tree(vectors, levels, branching, iterations, seed)
    return codes, decode_tree(codes, tree), {"tree": tree}


_QUANTIZERS = {"pq": _quantize_pq, "opq": _quantize_opq, "rkmeans": _quantize_tree}


def quantize(
    vectors: DataFrame,
    method: str = "pq",
    subspaces: int = 4,
    codebook_size: int = 256,
    levels: int = 4,
    branching: int = 16,
    iterations: int = 25,
    seed: int = 0,
) -> Quantized:
    """Fit, encode and reconstruct; codes and reconstruction are written once."""
    if method not in _QUANTIZERS:
        raise ValueError(f"unknown quantizer {method!r}; expected one of {METHODS}")
    clean = vectors.select("item_idx", V.scrub_non_finite("vec").alias("vec"))
    codes, decoded, model = _QUANTIZERS[method](
        clean, subspaces=subspaces, codebook_size=codebook_size, levels=levels,
        branching=branching, iterations=iterations, seed=seed,
    )
    codes, decoded = materialize(codes, "codes"), materialize(decoded, "reconstructed")
    mse = reconstruction_mse(clean, decoded).first()["mse"]
    return Quantized(method, codes, decoded, mse, model)
