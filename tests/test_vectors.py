import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import vector as V
from seqloom.operators import collaborative as C, fusion as Fu, gather as G, quantize as Q, sampling as Sa
from seqloom.operators.checks import parse_topk, require_all_items, require_catalogue, require_covers, require_divisible, vector_shape
from seqloom.operators.cooccurrence import cooccurrence, sppmi
from seqloom.operators.encode import encode_images, encode_texts, hashed_text_vectors, require_some_images
from seqloom.operators.sequences import build_samples, number_positions
from seqloom.sources.tables import dummy_vectors

VEC = "item_idx int, vec array<double>"


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], VEC)


def matrix(df, column="vec", key="item_idx"):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r[key])])


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8)) * 4
    return centers[rng.integers(6, size=240)] + rng.normal(size=(240, 8))


def test_fusion_goldens(spark):
    sources = {"a": frame(spark, [[3, 4]]), "b": frame(spark, [[0, 2]])}
    weights = {"a": 2.0, "b": 1.0}
    close = lambda got, want: np.testing.assert_allclose(matrix(got)[0], want, atol=1e-6)
    close(Fu.fuse(sources, "weighted_sum", weights, normalize_output=False), [0.4, 0.866667])
    close(Fu.fuse(sources, "weighted_sum", weights), [0.419058, 0.907959])
    close(Fu.fuse_concat(sources), [0.6, 0.8, 0, 1])
    close(Fu.fuse(sources, "concat"), [0.424264, 0.565685, 0, 0.707107])
    close(Fu.fuse(sources, "mean", weights, normalize_output=False), [0.3, 0.9])
    close(Fu.fuse(sources, "weighted_sum", {"a": 1.0}, normalize_each=False, normalize_output=False), [3, 4])
    for bad in (lambda: Fu.fuse(sources, "nope"), lambda: Fu.fuse(sources, "weighted_sum", {"x": 1.0}), lambda: Fu.fuse({}, "mean", validate=False)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Fu.fuse({"a": sources["a"], "b": frame(spark, [[0, 2], [1, 1]])})


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [float("nan"), float("inf"), None, 2.0])], "a array<double>, z array<double>, bad array<double>")
    r = df.select(
        V.l2_normalize("a").alias("n"), V.l2_normalize("z").alias("zero"), V.squared_l2("a", "z").alias("d"),
        V.dot("a", "a").alias("dot"), V.zero_pad("a", 3).alias("pad"), V.scrub_non_finite("bad").alias("s"),
        V.count_non_finite("bad").alias("c"), V.squared_l2("bad", "bad").alias("inf"),
    ).first()
    assert (r["n"], r["zero"], r["d"], r["dot"], r["pad"]) == ([0.6, 0.8], [0.0, 0.0], 25.0, 25.0, [3.0, 4.0, 0.0])
    assert (r["s"], r["c"], r["inf"]) == ([0.0, 0.0, 0.0, 2.0], 3, float("inf"))


def test_reduce_dim_matches_principal_axes(spark, cloud):
    got = matrix(Fu.reduce_dim(frame(spark, cloud), 3))
    centred = cloud - cloud.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert matrix(Fu.reduce_dim(frame(spark, cloud), 8)).shape == (240, 8)
    few = matrix(Fu.reduce_dim(frame(spark, cloud[:3]), 5))
    assert few.shape == (3, 5) and np.allclose(few[:, 3:], 0)


def samples_of(spark):
    data = [(u, (u * 3 + p * 5) % 7, p) for u in range(4) for p in range(6)]
    return build_samples(number_positions(spark.createDataFrame(data, "user_idx int, item_idx int, ts bigint")), 3)


def test_gather_and_pool(spark, cloud):
    vectors = frame(spark, cloud[:6])  # item 6 is missing
    samples = samples_of(spark)
    out = G.gather_history(samples, vectors, ["user_idx", "pos"])
    out = G.pool_history(out, vectors, ["user_idx", "pos"])
    joined = G.pool_history(samples, vectors, ["user_idx", "pos"], max_broadcast_bytes=0)
    by_join = {(r["user_idx"], r["pos"]): r["pooled"] for r in joined.collect()}
    known = G.gather_target(out, vectors)
    for r in known.collect():
        want = [cloud[i] if 0 <= i < 6 else np.zeros(8) for i in r["history"]]
        np.testing.assert_allclose(np.array(r["history_vecs"]), want)
        valid = [cloud[i] for i in r["history"] if 0 <= i < 6]
        mean = np.mean(valid, axis=0) if valid else np.zeros(8)
        np.testing.assert_allclose(r["pooled"], mean)
        np.testing.assert_allclose(by_join[r["user_idx"], r["pos"]], mean)
        np.testing.assert_allclose(r["target_vec"], cloud[r["target"]] if r["target"] < 6 else np.zeros(8))


def test_masked_mean_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, [2.0, 4.0], 1), (1, [4.0, 0.0], 1), (1, [9.0, 9.0], 0), (2, [1.0, 1.0], 0)], "k int, vec array<double>, mask int")
    assert {r["k"]: r["pooled"] for r in G.masked_mean(df, ["k"]).collect()} == {1: [3.0, 2.0], 2: [0.0, 0.0]}


def test_product_codes(spark, cloud):
    vectors = frame(spark, cloud)
    books = Q.fit_product(vectors, 2, 5, 4)
    held = {s: np.array([r["vec"] for r in sorted(books.collect(), key=lambda r: r["centroid_id"]) if r["subspace"] == s]) for s in (0, 1)}
    got = matrix(Q.encode_product(vectors, books), "code")
    for s in (0, 1):
        d = ((cloud[:, None, s * 4 : s * 4 + 4] - held[s][None]) ** 2).sum(-1)
        assert (got[:, s] == d.argmin(1)).all()
    assert (matrix(Q.encode_product(vectors, books, max_bytes=0), "code") == got).all()
    codes = Q.encode_product(vectors, books).select("item_idx", "code")
    np.testing.assert_allclose(matrix(Q.decode_product(codes, books))[:, 4:], held[1][got[:, 1]])
    with pytest.raises(ValueError):
        Q.fit_product(vectors, 3, 5)
    with pytest.raises(ValueError):
        Q.fit_kmeans(frame(spark, cloud[:3]), 4)


def test_nearest_takes_the_first_of_equal_centroids():
    label, dist = Q.nearest(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 0.0]]))
    assert label[0] == 1 and dist[0] == 1.0
    assert Q.nearest(np.array([[0.0]]), np.array([[np.nan], [3.0]]))[0][0] == 1


@pytest.mark.parametrize("method", Q.METHODS)
def test_quantizers_reconstruct_better_with_more_codes(spark, cloud, method):
    vectors = frame(spark, cloud)
    small = Q.quantize(vectors, method, 2, 2, 1, 2, 4)
    large = Q.quantize(vectors, method, 2, 12, 2, 6, 4)
    assert large.mse < small.mse < cloud.var(axis=0).mean()
    assert large.codes.count() == 240
    with pytest.raises(ValueError):
        Q.quantize(vectors, "nope")


def test_rotation_is_reversible(spark, cloud):
    vectors = frame(spark, cloud)
    rotation = Q.fit_rotation(vectors)
    np.testing.assert_allclose(matrix(rotation.undo(rotation.apply(vectors))), cloud, atol=1e-9)
    np.testing.assert_allclose(rotation.axes.T @ rotation.axes, np.eye(8), atol=1e-9)
    with pytest.raises(ValueError):
        Q.fit_rotation(frame(spark, cloud[:4]))


@pytest.mark.parametrize("center_bytes", [Q.MAX_CENTER_BYTES, 200])
def test_code_tree(spark, cloud, center_bytes):
    vectors = frame(spark, cloud)
    codes, tree = Q.fit_tree(vectors, 2, 3, 5, 1, center_bytes)
    got = {r["item_idx"]: tuple(r["code"]) for r in codes.collect()}
    nodes = {tuple(r["prefix"]): np.array(r["vec"]) for r in tree.nodes.collect()}
    for i, code in got.items():
        siblings = [(np.round(((cloud[i] - v) ** 2).sum(), 9), p[-1]) for p, v in nodes.items() if len(p) == 1]
        assert code[0] == min(siblings)[1]
    assert {r["item_idx"]: tuple(r["code"]) for r in Q.encode_tree(vectors, tree).collect()} == got
    decoded = matrix(Q.decode_tree(codes, tree))
    np.testing.assert_allclose(decoded[0], nodes[got[0]])
    odd = spark.createDataFrame([(0, [*got[0][:1], 99]), (1, [77, 0])], "item_idx int, code array<int>")
    fallback = matrix(Q.decode_tree(odd, tree))
    np.testing.assert_allclose(fallback[0], nodes[got[0][:1]])
    np.testing.assert_allclose(fallback[1], np.zeros(8))
    assert len({c[0] for c in got.values()}) == 3


def plain_split(ids, x, k, iterations, seed):
    """The same draws and steps for one bucket, in plain numpy."""
    chosen = [int(Q._hash_unit(ids, seed).argmax())]
    while len(chosen) < min(k, len(x)):
        dist = Q.nearest(x, x[chosen])[1]
        chosen.append(int(Q._far_weight(ids, dist, Q._step_seed(seed, len(chosen))).argmax()))
    centers = x[chosen].copy()
    for _ in range(iterations):
        label = Q.nearest(x, centers)[0]
        for c in set(label):
            centers[c] = x[label == c].mean(0)
    return Q.nearest(x, centers)[0]


@pytest.mark.parametrize("center_bytes", [Q.MAX_CENTER_BYTES, 900])
def test_codes_of_all_buckets_equal_those_of_each_alone(spark, center_bytes):
    rng = np.random.default_rng(6)
    few = rng.normal(size=(6, 4)) * 3
    points = np.vstack([rng.normal(size=(240, 4)), few[rng.integers(0, 6, 60)]])  # copies leave clusters empty
    want = [()] * len(points)
    for level in range(3):
        groups = {c: np.array([i for i in range(len(points)) if want[i] == c]) for c in set(want)}
        for code, ids in groups.items():
            for i, label in zip(ids, plain_split(ids, points[ids], 5, 6, 2 + level)):
                want[i] = (*code, int(label))
    vectors = frame(spark, points).repartition(5)
    got = {r["item_idx"]: tuple(r["code"]) for r in Q.fit_tree(vectors, 3, 5, 6, 2, center_bytes)[0].collect()}
    assert got == dict(enumerate(want))


def test_few_rows_make_few_clusters(spark):
    codes, _ = Q.fit_tree(frame(spark, [[0.0, 0.0], [5.0, 5.0]]), 2, 4, 3)
    assert len({tuple(r["code"]) for r in codes.collect()}) == 2


def test_weighted_draws(spark):
    weights = spark.createDataFrame([(0, 6.0), (1, 0.0), (2, 3.0), (3, 1.0)], "item_idx int, weight double")
    n = 6000
    out = Sa.sample_with_replacement(weights, n, 3)
    counts = dict(out.groupBy("item_idx").count().collect())
    assert sum(counts.values()) == n and 1 not in counts
    for item, p in ((0, 0.6), (2, 0.3), (3, 0.1)):
        assert abs(counts[item] - n * p) < 5 * (n * p * (1 - p)) ** 0.5
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = Sa.sample_with_replacement(weights.repartition(3), n, 3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.exceptAll(out).isEmpty()
    pairs = spark.range(300).select(F.col("id").alias("pair_id"))
    drawn = Sa.noise_negatives(pairs, weights.withColumnRenamed("weight", "prob"), 4)
    assert drawn.groupBy("pair_id").count().filter("count <> 4").isEmpty() and drawn.count() == 1200


def test_uniform_negatives(spark):
    owned = [(0, i) for i in range(10)] + [(1, i) for i in (0, 1, 2, 5, 9)] + [(2, 4)]
    rows = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 4).cast("int").alias("user_idx"))
    out = Sa.uniform_negatives(rows, spark.createDataFrame(owned, "user_idx int, item_idx int"), 10, 5).collect()
    by_user = {u: [r["negative"] for r in out if r["user_idx"] == u] for u in range(4)}
    assert by_user[0] == []  # owns everything
    for user, want in ((1, {3, 4, 6, 7, 8}), (2, set(range(10)) - {4}), (3, set(range(10)))):
        assert len(by_user[user]) == 1000 and set(by_user[user]) == want
        p = 1 / len(want)
        assert all(abs(by_user[user].count(i) - 1000 * p) < 5 * (1000 * p * (1 - p)) ** 0.5 for i in want)


def test_epoch_order_is_a_fixed_permutation(spark):
    df = spark.range(50)
    one = [r["id"] for r in Sa.epoch_order(df, ["id"], 1, 0).collect()]
    assert sorted(one) == list(range(50)) and one != sorted(one)
    assert one == [r["id"] for r in Sa.epoch_order(df.repartition(7), ["id"], 1, 0).collect()]
    assert one != [r["id"] for r in Sa.epoch_order(df, ["id"], 1, 1).collect()]


def test_dummy_vectors(spark):
    got = matrix(dummy_vectors(spark.range(400).select(F.col("id").cast("int").alias("item_idx")), 16, 2))
    assert abs(got.mean()) < 0.05 and abs(got.std() - 1) < 0.05
    part = matrix(dummy_vectors(spark.range(3, 5).select(F.col("id").cast("int").alias("item_idx")), 16, 2))
    np.testing.assert_array_equal(part, got[3:5])


def test_sparse_projection_matches_dense_axes(spark):
    rng = np.random.default_rng(0)
    dense = rng.random((40, 40)) * (rng.random((40, 40)) < 0.3)
    dense[:20] += (np.arange(40) % 2) * 0.7
    cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(40) if dense[i, j]], "item_i int, item_j int, sppmi double")
    items = spark.range(40).select(F.col("id").cast("int").alias("item_idx"))
    got = matrix(C.project_sparse(cells, items, 32))
    centred = dense - dense.mean(0)
    u, s, _ = np.linalg.svd(centred)
    want = u[:, :32] * s[:32]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    np.testing.assert_allclose(got @ got.T, want @ want.T, atol=1e-6)
    padded = matrix(C.project_sparse(cells, items, 48))
    np.testing.assert_allclose(padded[:, :40] * np.linalg.norm(dense, axis=1, keepdims=True), dense, atol=1e-9)


@pytest.fixture(scope="module")
def cliques(spark):
    """Two groups of users with separate items: neighbours should end up close."""
    rng = np.random.default_rng(3)
    data = [(u, int(rng.integers(5)) + 5 * (u % 2), t) for u in range(40) for t in range(20)]
    return spark.createDataFrame(data, "user_idx int, item_idx int, ts bigint")


@pytest.mark.parametrize("method,options", [
    ("item_item_sppmi", {"dim": 4}),
    ("item2vec", {}),
    ("item2vec", {"dim": 6, "negatives": 1, "blocks": 2}),
    ("mf_bpr", {}),
    ("mf_bpr", {"dim": 6, "negatives": 3, "blocks": 1}),
])
def test_collaborative_vectors_separate_groups(spark, cliques, method, options):
    items = spark.range(10).select(F.col("id").cast("int").alias("item_idx"))
    got = matrix(C.collaborative_vectors(method, number_positions(cliques), items, **options))
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), 1, atol=1e-6)
    sim = got @ got.T
    inside = np.mean([sim[i, j] for i in range(10) for j in range(10) if i != j and i // 5 == j // 5])
    across = np.mean([sim[i, j] for i in range(10) for j in range(10) if i // 5 != j // 5])
    assert inside > across + 0.5
    with pytest.raises(ValueError):
        C.collaborative_vectors("nope", cliques, items)


def test_als_covers_the_catalogue(spark, cliques):
    items = spark.range(12).select(F.col("id").cast("int").alias("item_idx"))
    got = matrix(C.als_vectors(cliques, items, 4, 3))
    assert got.shape == (12, 4) and np.allclose(np.linalg.norm(got[:10], axis=1), 1) and np.allclose(got[10:], 0)


def test_encoders(spark, tmp_path):
    texts = spark.createDataFrame([(0, "red ring"), (1, "red ring"), (2, "blue car")], "item_idx int, text string")
    made = matrix(encode_texts(texts, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch])))
    np.testing.assert_allclose(np.linalg.norm(made, axis=1), 1)
    hashed = matrix(hashed_text_vectors(texts, 32))
    np.testing.assert_allclose(hashed[0], hashed[1])
    (tmp_path / "a.jpg").write_bytes(b"abc")
    (tmp_path / "b.jpg").write_bytes(b"")
    root = f"file:{tmp_path}"
    found = spark.createDataFrame([(0, f"file:{tmp_path}/a.jpg"), (1, f"file:{tmp_path}/b.jpg"), (2, None)], "item_idx int, path string")
    encoder = lambda: lambda blobs: [[len(b), 0.0] if b else None for b in blobs]
    out = encode_images(spark, found, root, encoder, 2)
    assert sorted((r["item_idx"], r["vec"], r["missing"]) for r in out.collect()) == [(0, [1.0, 0.0], False), (1, [0.0, 0.0], True), (2, [0.0, 0.0], True)]
    require_some_images(out)
    with pytest.raises(ValueError):
        require_some_images(out.filter("missing"))


def test_checks(spark, cloud):
    vectors = frame(spark, cloud[:5])
    assert vector_shape(vectors).dim == 8
    with pytest.raises(ValueError):
        vector_shape(frame(spark, [[1.0], [1.0, 2.0]]))
    items = spark.range(6).select(F.col("id").cast("int").alias("item_idx"))
    with pytest.raises(ValueError):
        require_catalogue(vectors, items)
    with pytest.raises(KeyError):
        require_all_items(vectors, items)
    with pytest.raises(ValueError):
        require_covers(vectors, samples_of(spark))
    with pytest.raises(ValueError):
        require_divisible(10, 4)
    assert parse_topk("20,5, 5") == [5, 20]
    for bad in ("", "0,5", "-1"):
        with pytest.raises(ValueError):
            parse_topk(bad)
