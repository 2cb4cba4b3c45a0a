"""Steps named by the fourth round of findings: the whole results with less work, memory and traffic."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.operators import batches as B, codes as K, gridtrain as G, retrieval as R
from seqloom.operators.gather import as_lists, as_matrix
from seqloom.plans.evaluate import pooled_queries


def _state(q, target, seen, own=None, top=None):
    n = len(q)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("item_idx", pa.int32())]))
    columns = {
        "target": pa.array(target, pa.int32()), "vec": as_lists(q), "seen": pa.array(seen, pa.list_(pa.int32())),
        "target_score": pa.nulls(n, pa.float64()), "better": pa.array(np.zeros(n, np.int64)), "top": pa.array([[]] * n, kind),
        "lse": pa.array(np.full(n, -np.inf)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _brute(scores, penalised, target, seen, k, tau):
    n, width = scores.shape
    rounded = np.round(penalised, 10)
    rank, top = [], []
    for i in range(n):
        left = [j for j in range(width) if j == target[i] or j not in set(seen[i])]
        own = np.inf if target[i] is None else rounded[i, target[i]]
        rank.append(sum(rounded[i, j] > own for j in left))
        top.append(sorted(((-rounded[i, j], j) for j in left))[:k])
    lse = np.log(np.exp(scores / tau).sum(axis=1)) if tau else None
    return rank, top, lse


def _check(out, want, k, tau):
    rank, top, lse = want
    assert out["better"].to_pylist() == rank
    got = out["top"].to_pylist()
    assert [[t["item_idx"] for t in row] for row in got] == [[j for _, j in row] for row in top]
    assert [[t["score"] for t in row] for row in got] == [[-s for s, _ in row] for row in top]
    if tau:
        np.testing.assert_allclose(out["lse"].to_numpy(), lse, rtol=1e-12)


@pytest.mark.parametrize("score", ["dot", "neg_l2"])
@pytest.mark.parametrize("k, tau, weight, size", [(0, None, 0.0, 1.0), (7, None, 0.3, 1.0), (300, None, 0.0, 1.0), (5, 0.5, 0.2, 1.0), (5, 0.001, 0.0, 1.0), (4, None, 0.0, 1e25)])
def test_single_precision_scores_give_the_ranks_of_double_ones(score, k, tau, weight, size, monkeypatch):
    """Scores apart by less than single precision tells, equal ones, and ones beyond its range."""
    rng = np.random.default_rng(3)
    n, width = 70, 701
    items = rng.normal(size=(width, 6)) * (size if score == "dot" else min(size, 1e12))
    items[350:] = items[:351] * (1 + rng.choice([0.0, 3e-9, 2e-12], (351, 1)))
    q, penalty = rng.normal(size=(n, 6)) * size if score == "dot" else rng.normal(size=(n, 6)), rng.random(width)
    q[3] = 0.0  # all scores of dot are equal
    target = [int(x) for x in rng.integers(0, width, n)]
    target[5] = None
    seen = [[int(x) for x in rng.integers(-1, width, 9)] for _ in range(n)]
    seen[0][0] = target[0]
    kinds = []
    plain = R.SCORES[score]
    monkeypatch.setitem(R.SCORES, score, (lambda a, b: kinds.append((a.dtype, len(a) * len(b))) or plain[0](a, b), plain[1]))
    block, rules = R._Block(np.arange(width), items, penalty), R._Rules(score, k, weight, tau, 10, ("id",))
    rows = _state(q, target, seen)
    out = R._rank_rows(R._score_targets(rows, block, rules), block, rules)
    exact = q @ items.T if score == "dot" else 2 * (q @ items.T) - (q**2).sum(1)[:, None] - (items**2).sum(1)
    if size == 1.0:
        _check(out, _brute(exact, exact - weight * penalty, target, seen, k, tau if tau != 0.001 else None), k, tau if tau != 0.001 else None)
    assert np.isfinite(out["lse"].to_numpy()).all() or not tau
    single = sum(cells for kind, cells in kinds if kind == np.float32)
    assert single == (n * width if tau is None and (size == 1.0 or score == "neg_l2") else 0)
    assert max(cells for _, cells in kinds) <= 1 << 17


def test_blocks_carry_best_items_and_floats_are_kept_as_they_are(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32))], "item_idx int, vec array<float>")
    data = [(i, rng.normal(size=4).tolist(), int(rng.integers(60)), rng.integers(0, 60, 3).tolist(), [True] * 3) for i in range(25)]
    queries = spark.createDataFrame(data, "id int, vec array<double>, target int, history array<int>, mask array<boolean>")
    assert R._Block.of(items.selectExpr("item_idx", "vec", "0D as penalty")).vecs.dtype == np.float32
    whole, cut = (sorted(R.rank_catalogue(queries, items, ["id"], 6, block_bytes=size).collect()) for size in (1 << 20, 500))
    assert whole == cut
    doubled = items.selectExpr("item_idx", "cast(vec as array<double>) as vec")
    assert sorted(R.rank_catalogue(queries, doubled, ["id"], 6).collect()) == whole


@pytest.mark.parametrize("k, tau, weight", [(0, None, 0.0), (6, None, 0.0), (6, 0.7, 0.0), (6, 0.7, 0.2), (400, None, 0.0)])
def test_items_of_one_code_are_scored_once(k, tau, weight, monkeypatch):
    rng = np.random.default_rng(6)
    n, width = 40, 900
    codes = rng.integers(0, 4, (width, 3)) * [1, 1, 1] + [0, 4, 8]
    q = np.log(rng.dirichlet(np.ones(12), n))
    q[2] = q[2, 0]  # all scores are equal
    target = [int(x) for x in rng.integers(0, width, n)]
    target[5] = None
    seen = [[int(x) for x in rng.integers(-1, width, 9)] for _ in range(n)]
    best = q[1, codes].sum(axis=1)
    seen[1] = np.flatnonzero(best == best.max())[:40].tolist()  # the best code has no item left
    penalty = rng.choice([0.0, 1.0], width)
    scored = []
    whole = R._CodeTree.scores
    monkeypatch.setattr(R._CodeTree, "scores", lambda self, places, start, end: scored.append(end - start) or whole(self, places, start, end))
    block, rules = R._Block(np.arange(width), codes.astype(float), penalty), R._Rules("code", k, weight, tau, 10, ("id",))
    rows = _state(q, target, seen)
    out = R._rank_rows(R._score_targets(rows, block, rules), block, rules)
    exact = sum(q[:, codes[:, c]] for c in range(3))
    _check(out, _brute(exact, exact - weight * penalty, target, seen, k, tau), k, tau)
    assert sum(scored) == (64 if weight == 0.0 else 128)


def test_few_bytes_of_queries_are_dealt_to_many_tasks(spark):
    vectors = spark.createDataFrame([(i, [1.0 * i, 1.0]) for i in range(5)], "item_idx int, vec array<float>")
    samples = spark.createDataFrame([(u, 1, [u % 5, -1], [True, False], 1) for u in range(640)], "user_idx int, pos int, history array<int>, mask array<boolean>, target int").coalesce(1)
    queries = pooled_queries(samples, vectors, ["user_idx", "pos"])
    sizes = [r["count"] for r in queries.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    assert {r["user_idx"]: r["vec"] for r in queries.collect()} == {u: [u % 5, 1.0] for u in range(640)}


def test_many_idle_items_of_a_block_leave_a_skipgram_step_dense(monkeypatch):
    """Drawn negatives beside a few frequent items: no row of floats for every visit."""
    rng = np.random.default_rng(2)
    width, idle = 6, 400
    side = lambda kind, n, mass: [(kind, i, 0, rng.normal(size=width).tolist(), 0.0, mass[i], None, None) for i in range(n)]
    pairs = [(2, u, 0, None, None, None, p, 50) for u in range(5) for p in range(7)]
    names = ["kind", "id", "part", "vec", "moved", "mass", "other", "n"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    rows = side(0, 5, [0.0] * 5) + side(1, 7 + idle, [100.0] * 7 + [1.0] * idle) + pairs
    table = pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows), types)], names)
    t, seen = G.Training("skipgram", width, negatives=10, batch=64, reg=0.01), []
    monkeypatch.setattr(G._Side, "step", lambda self, rows, gradient, rate: seen.append(len(rows)))
    dense = G._train_cell(t, (0, 0), 1)((pa.scalar(1),), table)
    assert not seen
    monkeypatch.undo()
    monkeypatch.setattr(G, "_counted", lambda *a: False)
    one_by_one = G._train_cell(t, (0, 0), 1)((pa.scalar(1),), table)
    np.testing.assert_allclose(as_matrix(dense["vec"]), as_matrix(one_by_one["vec"]), rtol=1e-8, atol=1e-10)


def test_factors_are_written_once_an_epoch_and_travel_as_floats(spark, monkeypatch):
    written = []
    plain = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label, *a, **kw: written.append((label, dict(df.dtypes).get("vec"))) or plain(df, label, *a, **kw))
    pairs = spark.createDataFrame([(u, (u * 5 + n) % 9, 2) for u in range(12) for n in range(4)], "left bigint, right bigint, n bigint")
    ids = lambda n: spark.range(n).select("id", F.lit(1.0).alias("mass"))
    left, right = G.train_factors(pairs, ids(12), ids(9), G.Training("ranking", 4, epochs=3, blocks=5))
    assert [kind for label, kind in written if label == "grid-factors"] == ["array<float>"] * 3
    assert left.count() == 12 and right.count() == 9 and dict(right.dtypes)["vec"] == "array<double>"


def test_large_factors_travel_less_often():
    t = G.Training("ranking", 128)
    assert G._block_count(t, 26_400_000, 720_000, 36_000_000) == 11 and G._block_count(t, 26_400_000, 100_000, 36_000_000) == 17
    assert [G._block_count(G.Training("skipgram", 128), 10_000, 100_000, n) for n in (6_000_000, 60_000_000)] == [4, 8]


def test_codes_are_decoded_by_a_tree_that_travels(spark):
    """Null, NaN, short and equal logits, unknown prefixes and free decoding: as by joins, without moving a sample."""
    rng = np.random.default_rng(9)
    layout = K.TokenLayout((3, 4, 2))
    codes = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(rng.integers(0, [3, 4, 2], (9, 3)))], "item_idx int, code array<int>")
    logits = np.round(rng.normal(size=(60, 3, layout.vocab_size)), 0).tolist()
    logits[0][0][6], logits[1][1][9], logits[2][0][5], logits[3][2] = None, float("nan"), -0.0, logits[3][2][:12]
    logits[4][0][5:8], logits[5] = [float("-inf")] * 3, None
    samples = spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "id int, logits array<array<double>>")
    table = K.prefix_table(codes)
    cut = table.filter("size(prefix) < 2")  # nothing is known of the last step
    odd = table.unionByName(spark.createDataFrame([([2, 3], [1], False), ([7], [], False)], table.schema)).dropDuplicates(["prefix"])
    answers = lambda df: [(r["id"], r["code"]) for r in df.orderBy("id").collect()]
    for prefixes in (table, cut, odd):
        got, want = K.greedy_decode(samples, layout, prefixes), K.greedy_decode(samples, layout, prefixes, max_trie_entries=-1)
        assert got.columns == want.columns == ["id", "logits", "code"]
        assert answers(got) == answers(want)
    free = K.greedy_decode(samples, layout)
    step = lambda state, i: state.withColumn("step_logits", F.col("logits")[i])
    assert answers(free) == answers(K.greedy_decode(samples, layout, None, step))
    for plan in (K.greedy_decode(samples, layout, table), free):
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_large_catalogue_reaches_each_task_once(spark):
    """No history slot and no sample with vectors is shuffled: only narrow samples and the items that a task uses."""
    rng = np.random.default_rng(8)
    vecs = lambda dim: spark.createDataFrame([(i * 3, rng.normal(size=dim).tolist()) for i in range(9)], "item_idx int, vec array<double>")
    text, cf = vecs(5), vecs(2)
    data = [(i, [int(x) * 3 for x in rng.integers(0, 9, 4)], [bool(b) for b in rng.integers(0, 2, 4)], int(rng.integers(0, 9)) * 3) for i in range(200)]
    data += [(200, [-1, 3], [True, True], -1), (201, [], [], 0), (202, [3, 4], [True, False], 3), (203, [3, None, 6], [None, True, True], 3)]
    samples = spark.createDataFrame(data, "id int, h array<int>, m array<boolean>, target int")
    attach = lambda rows, **kw: B.attach_branches(rows, {"text": text, "cf": cf}, ["id"], cf, "h", "m", "target", **kw)
    got, want = attach(samples, max_broadcast_bytes=0, task_rows=30), attach(samples)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert got.rdd.getNumPartitions() == 7
    plan = got._jdf.queryExecution().analyzed().toString()
    above = plan[: plan.index("MapInArrow")]  # what is done to samples that have their vectors
    assert "Join" not in above and "Aggregate" not in above and "Repartition" not in above
    for broken, match in (((500, [5], [True], 0), "item 5 has no"), ((500, [3], [True], 5), "item 5 has no"), ((500, [3], [True], None), "no target")):
        with pytest.raises(Exception, match=match):
            attach(spark.createDataFrame([broken], samples.schema), max_broadcast_bytes=0).collect()
