"""Steps named by the third round of findings: held memory, shuffles and equal results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import toxicity
from seqloom.operators import batches as B, gridtrain as G, losses as L, retrieval as R, sequences as S
from seqloom.operators.gather import as_lists, as_matrix, item_names
from seqloom.plans.prepare import prepare
from seqloom.sources import records as Rc


def test_ranking_holds_few_scores_at_once_and_rounds_as_a_whole():
    rng = np.random.default_rng(4)
    n, width = 300, 2000
    items = np.round(rng.normal(size=(width, 3)), 1)
    items[1000:] = items[:1000] + rng.choice([0.0, 4e-12, 6e-11], (1000, 3))  # ties only after rounding
    q, target = np.round(rng.normal(size=(n, 3)), 1), rng.integers(0, width, n)
    block, rules = R._Block(np.arange(width), items, np.zeros(width)), R._Rules("dot", 9, 0.0, None, 10, ("id",))
    none = pa.array([[]] * n, pa.list_(pa.struct([("score", pa.float64()), ("item_idx", pa.int32())])))
    names = ["target", "vec", "seen", "target_score", "better", "top", "lse"]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(target.astype(np.int32)), as_lists(q), pa.array([[-1]] * n, pa.list_(pa.int32())), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, np.int64)), none, pa.array(np.full(n, -np.inf))], names
    )
    held = []

    def spy(queries, vecs):
        held.append(len(queries) * len(vecs))
        return queries @ vecs.T

    kept = R.SCORES["dot"]
    R.SCORES["dot"] = (spy, kept[1])
    try:
        out = R._rank_rows(R._score_targets(rows, block, rules), block, rules)
    finally:
        R.SCORES["dot"] = kept
    assert max(held) <= 1 << 18 and sum(held) == n * width
    whole = np.round(q @ items.T, 10)
    assert out["better"].to_pylist() == (whole > whole[np.arange(n), target][:, None]).sum(axis=1).tolist()
    for i, top in enumerate(out["top"].to_pylist()):
        assert [t["item_idx"] for t in top] == np.lexsort((np.arange(width), -whole[i]))[:9].tolist()


def test_losses_of_arrays_equal_those_of_rows_without_a_shuffle(spark):
    rng = np.random.default_rng(3)
    logits, labels = rng.normal(size=(30, 2, 7)), rng.integers(0, 7, (30, 2))
    labels[4, 1] = labels[7] = -100
    wide = spark.createDataFrame([(i // 4, i, logits[i].tolist(), labels[i].tolist()) for i in range(30)], "b int, id int, logits array<array<double>>, labels array<int>")
    long = wide.select("b", "id", "labels", F.posexplode("logits").alias("c", "row")).select(
        "b", "id", "c", F.col("labels")[F.col("c")].alias("label"), F.posexplode("row").alias("token", "logit")
    )
    blocked = long.withColumn("logit", F.when((F.col("token") >= 1 + 3 * F.col("c")) & (F.col("token") < 4 + 3 * F.col("c")), F.col("logit")).otherwise(-1e9))
    value = lambda df: df.first()["loss"]
    assert value(L.cross_entropy_arrays(wide, label_smoothing=0.2)) == pytest.approx(value(L.masked_cross_entropy(long, ["id", "c"], 0.2)))
    assert value(L.cross_entropy_arrays(wide, label_smoothing=0.2, batch="b")) == pytest.approx(value(L.masked_cross_entropy(long, ["id", "c"], 0.2, "b")))
    kept = F.col("label").isin(-100) | ((F.col("label") >= 1 + 3 * F.col("c")) & (F.col("label") < 4 + 3 * F.col("c")))
    inside = wide.filter(F.col("id").isin([r["id"] for r in long.groupBy("id").agg(F.bool_and(kept).alias("ok")).filter("ok").collect()]))
    want = value(L.masked_cross_entropy(blocked.join(inside.select("id"), "id"), ["id", "c"]))
    assert value(L.cross_entropy_arrays(inside, ranges=[(1, 4), (4, 7)])) == pytest.approx(want)
    probs = L.log_softmax_arrays(wide)
    assert "Exchange" not in probs._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["log_probs"] for r in probs.collect()}
    np.testing.assert_allclose(np.array(got[3]).reshape(2, 7), logits[3] - np.log(np.exp(logits[3]).sum(1, keepdims=True)))


def _cell(n_left, n_right, seed=2):
    rng = np.random.default_rng(seed)
    width = 6
    side = lambda kind, n: [(kind, i, 0, rng.normal(size=width).tolist(), 0.0, float(i + 1), None, None) for i in range(n)]
    pairs = [(2, u, 0, None, None, None, p, int(rng.integers(1, 40))) for u in range(n_left) for p in range(n_right) if rng.random() < 0.7]
    names = ["kind", "id", "part", "vec", "moved", "mass", "other", "n"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    columns = zip(*(side(0, n_left) + side(1, n_right) + pairs))
    return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, types)], names)


def test_skipgram_step_of_a_small_block_computes_each_pair_once(monkeypatch):
    """Same draws and sums as pair by pair, without a row of floats for every visit."""
    table, t = _cell(5, 7), G.Training("skipgram", 6, negatives=3, batch=32, reg=0.01)
    key = (pa.scalar(1),)
    seen = []
    monkeypatch.setattr(G._Side, "step", lambda self, rows, gradient, rate: seen.append(len(rows)))
    dense = G._train_cell(t, (0, 0), 1)(key, table)
    assert not seen
    monkeypatch.undo()
    monkeypatch.setattr(G, "_counted", lambda *a: False)
    rows = G._train_cell(t, (0, 0), 1)(key, table)
    np.testing.assert_allclose(as_matrix(dense["vec"]), as_matrix(rows["vec"]), rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(dense["moved"].to_numpy(), rows["moved"].to_numpy(), rtol=1e-8)


def test_scored_texts_that_are_kept_go_to_python_once(spark):
    model = toxicity.FactorizationMachine(np.zeros(0, np.int32), -1.0, np.zeros((0, 9), np.float32))
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    both = toxicity.score(docs, model, ["doc_id", "text"])
    assert "whole_text" not in both._jdf.queryExecution().analyzed().toString()
    rows = {r["doc_id"]: (r["text"], r["score"]) for r in both.collect()}
    alone = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert rows == {1: ("a b", alone[1]), 2: (None, alone[2]), 3: ("", alone[3])}


def test_history_names_meet_a_row_once(spark):
    rows = [(f"u{u}", f"i{(u * 7 + n * n) % 5}", n // 2) for u in range(6) for n in range(8)]
    p = prepare(spark.createDataFrame(rows, "user_id string, item_id string, ts long"), 2)
    got = p.history_names(3)
    want = item_names(p.samples(3), p.item_map, ["user_idx", "pos"])
    key = lambda df: sorted((r["user_idx"], r["pos"], tuple(r["history_items"])) for r in df.collect())
    assert key(got) == key(want)
    assert "posexplode" not in got._jdf.queryExecution().analyzed().toString().lower()


def test_json_that_is_no_record_is_not_handed_to_python(spark, monkeypatch):
    kept = []
    real = Rc.materialize
    monkeypatch.setattr(Rc, "materialize", lambda df, label, *a: kept.append((label, real(df, label, *a))) or kept[-1][1])
    values = ["[1, 2]", "3", "null", '"x"', "{'a': 1}", "{broken", '{"a": 1}', None]
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, line_order int")
    parsed = Rc.split_records(lines)
    assert {r["line_order"] for r in parsed.records.collect()} == {4, 6}
    assert {r["line_order"]: r["reason"] for r in parsed.rejected.collect()} == {
        0: "not a record", 1: "not a record", 2: "not a record", 3: "not a record", 5: "neither JSON nor a literal", 7: "no line"
    }
    tried = dict(kept)["repaired-lines"]
    assert {r["line_order"] for r in tried.collect()} == {4, 5}


def test_ranks_alone_hold_no_best_items_and_return_no_vectors(spark):
    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(i, np.round(v, 1).tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], "item_idx int, vec array<double>")
    data = [(i, np.round(rng.normal(size=3), 1).tolist(), int(rng.integers(40)), rng.integers(0, 40, 4).tolist(), [False, True, True, True]) for i in range(30)]
    queries = spark.createDataFrame(data, "id int, vec array<double>, target int, history array<int>, mask array<boolean>")
    for more in ({}, {"block_bytes": 400}):  # one block; many
        whole, alone = (R.rank_catalogue(queries, items, ["id"], k, temperature=0.5, **more) for k in (5, 0))
        seen = ["id", "target", "target_score", "rank", "log_sum_exp"]
        assert sorted(alone.select(*seen).collect()) == sorted(whole.select(*seen).collect())
        assert {len(r["top"]) for r in alone.collect()} == {0} and {len(r["top"]) for r in whole.collect()} == {5}
    ranked = R.rank_catalogue(queries, items, ["id"], 0)
    told = ranked._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].split("\n")[0]
    assert "better" in told and "vec" not in told.split("[", 1)[1] and "seen" not in told.split("[", 1)[1], told


def test_branches_of_a_small_catalogue_are_attached_without_moving_samples(spark):
    rng = np.random.default_rng(8)
    vecs = lambda dim: spark.createDataFrame([(i * 3, rng.normal(size=dim).tolist()) for i in range(9)], "item_idx int, vec array<double>")
    text, cf = vecs(5), vecs(2)
    data = [(i, [int(x) * 3 for x in rng.integers(0, 9, 4)], [bool(b) for b in rng.integers(0, 2, 4)], int(rng.integers(0, 9)) * 3) for i in range(40)]
    data += [(40, [-1, 3], [True, True], -1), (41, [], [], 0), (42, [3, 4], [True, False], 3), (43, [3, None, 6], [None, True, True], 3)]
    samples = spark.createDataFrame(data, "id int, h array<int>, m array<boolean>, target int")
    attach = lambda rows, **kw: B.attach_branches(rows, {"text": text, "cf": cf}, ["id"], cf, "h", "m", "target", **kw)
    got, want = attach(samples), attach(samples, max_broadcast_bytes=0)
    assert got.columns == want.columns and [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange hashpartitioning" in want._jdf.queryExecution().executedPlan().toString()
    for broken in ({"text": text.filter("item_idx > 0"), "cf": cf}, {"text": text.filter("item_idx > 0")}):
        with pytest.raises(Exception, match="item 0 has no"):
            B.attach_branches(samples.limit(41).select("id", "h", "m", F.lit(3).alias("target")), broken, ["id"], None, "h", "m", "target").collect()


def test_tasks_of_positions_grow_in_number_with_the_rows(spark, monkeypatch):
    rows = [(f"u{u}", f"i{(u * 7 + n * n) % 5}", n // 2) for u in range(60) for n in range(8)]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, ts long")
    plain = prepare(frame, 2)
    want = sorted(plain.chunks(3, 50).collect())
    monkeypatch.setattr(S, "TASK_ROWS", 20)
    p = prepare(frame, 2)
    assert sorted(p.chunks(3, 50).collect()) == want
    tasks = -(-p.core.trace[-1][2] // 20)
    assert p.positions.rdd.getNumPartitions() == p.samples(3).rdd.getNumPartitions() == tasks > plain.positions.rdd.getNumPartitions()


def test_more_pairs_are_trained_by_more_tasks():
    t = G.Training("ranking", 128)
    assert [G._block_count(t, n, 100_000) for n in (100_000, 4_900_000, 30_000_000)] == [4, 7, 18]
    assert G._block_count(G.Training("ranking", 128, blocks=3), 30_000_000, 100_000) == 3
