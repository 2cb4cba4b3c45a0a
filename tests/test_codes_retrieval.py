import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import batches as B, codes as K, losses as L, popularity as P, retrieval as R
from seqloom.plans.evaluate import code_items, code_queries, evaluate

VEC = "item_idx int, vec array<double>"


@pytest.fixture(scope="module")
def two_codes(spark):
    return spark.createDataFrame([(0, "x", [2, 3]), (1, "y", [0, 1])], "item_idx int, item_id string, code array<int>")


@pytest.mark.parametrize("cells", [K.MAX_LOOKUP_CELLS, 0])
def test_tokenize_golden(spark, two_codes, cells):
    layout = K.infer_layout(two_codes)
    assert (layout.vocab_sizes, layout.offsets, layout.vocab_size, layout.max_seq_len(2)) == ((3, 4), (5, 8), 12, 10)
    samples = spark.createDataFrame([("train", 0, 1, [-1, 0], [False, True], 1)], "split string, user_idx int, pos int, history array<int>, mask array<boolean>, target int")
    r = K.tokenize_samples(samples, two_codes, layout, 2, max_lookup_cells=cells).first()
    assert r["input_ids"] == [2, 7, 11, 3, 1, 1, 4, 0, 0, 0]
    assert r["labels"] == [-100, -100, -100, -100, 5, 9, -100, -100, -100, -100]
    assert r["token_slot_ids"] == [-1, 1, 1, 1, 2, 2, -1, -1, -1, -1]
    assert r["token_codebook_ids"] == [-1, 0, 1, -1, 0, 1, -1, -1, -1, -1]
    assert r["attention_mask"] == [True] * 7 + [False] * 3 and r["seq_lengths"] == 7
    assert r["history_semantic_ids"] == [[-1, -1], [2, 3]] and r["target_semantic_ids"] == [0, 1]


def test_tokenize_special_ids_gaps_and_masks(spark, two_codes):
    layout = K.infer_layout(two_codes, pad=4, eos=0)
    data = [("train", 0, 1, [0, 1, 1], [True, False, True], 0), ("test", 0, 2, [-1, -1, -1], [False] * 3, 1)]
    samples = spark.createDataFrame(data, "split string, user_idx int, pos int, history array<int>, mask array<boolean>, target int")
    out = K.tokenize_samples(samples, two_codes, layout, 3)
    one, two = out.orderBy("pos").collect()
    assert one["input_ids"] == [2, 7, 11, 3, 5, 9, 3, 1, 1, 0, 4, 4, 4]
    assert one["token_slot_ids"] == [-1, 0, 0, 0, 2, 2, 2, 3, 3, -1, -1, -1, -1]
    assert two["input_ids"] == [2, 1, 1, 0] + [4] * 9
    places = K.target_positions(out, 2).orderBy("pos").collect()
    assert [r["target_positions"] for r in places] == [[7, 8], [1, 2]]
    broken = out.withColumn("labels", F.array_repeat(F.lit(-100), 13))
    with pytest.raises(Exception, match="mask every code position"):
        K.target_positions(broken, 2).collect()
    with pytest.raises(Exception, match="without a code"):
        K.tokenize_samples(samples.withColumn("target", F.lit(9)), two_codes, layout, 3).collect()
    assert B.assemble_batch(out.withColumn("pooled_cf_embed", F.array(F.lit(1.0))).withColumn("junk", F.lit(1))).columns[-1] == "pooled_cf_embed"
    with pytest.raises(KeyError):
        B.assemble_batch(out.drop("labels"))
    renamed = B.normalize_columns(out.withColumnRenamed("target_item_ids", "target_item_id"))
    assert {"target_item_ids", "history_masks", "seq_lengths"} <= set(renamed.columns)


@pytest.mark.parametrize("cells", [K.MAX_LOOKUP_CELLS, 0])
@pytest.mark.parametrize("unknown", [1, 9])
def test_tokenize_history_without_code_is_an_error(spark, cells, unknown):
    codes = spark.createDataFrame([(0, "x", [2, 3]), (2, "y", [0, 1])], "item_idx int, item_id string, code array<int>")
    samples = spark.createDataFrame([("train", 0, 1, [unknown, 0], [True, True], 2)], "split string, user_idx int, pos int, history array<int>, mask array<boolean>, target int")
    with pytest.raises(Exception, match="history item has no code"):
        K.tokenize_samples(samples, codes, K.infer_layout(codes), 2, max_lookup_cells=cells).collect()


def test_rank_catalogue_unknown_target_is_an_error(spark):
    items = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VEC)
    queries = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 7)], "id int, vec array<double>, target int")
    with pytest.raises(Exception, match="target is not in the items"):
        R.rank_catalogue(queries, items, ["id"], 1, exclude_history=False).collect()


def test_layout_and_code_errors(spark, two_codes):
    for bad in ([], [(0, [1]), (1, [1, 2])], [(0, []), (1, [])]):
        with pytest.raises(ValueError):
            K.infer_layout(spark.createDataFrame(bad, "item_idx int, code array<int>"))
    layout = K.infer_layout(two_codes)
    wrong = spark.createDataFrame([([3, 0],), ([0],)], "code array<int>")
    for n in (0, 1):
        with pytest.raises(Exception, match="does not fit"):
            wrong.filter(F.size("code") == (2 - n)).select(K.encode_code("code", layout)).collect()
    tokens = K.candidate_tokens(two_codes, layout).withColumn("value", K.decode_token(F.col("codebook"), F.col("token"), layout))
    assert sorted((r["item_idx"], r["codebook"], r["value"]) for r in tokens.collect()) == [(0, 0, 2), (0, 1, 3), (1, 0, 0), (1, 1, 1)]


def test_prefixes_groups_and_lookups(spark):
    codes = spark.createDataFrame([(2, "c", [0, 1]), (0, "a", [0, 1]), (1, "b", [0, 2]), (3, "d", [1, 0])], "item_idx int, item_id string, code array<int>")
    table = {tuple(r["prefix"]): (r["next_values"], r["is_code"]) for r in K.prefix_table(codes).collect()}
    assert table == {(): ([0, 1], False), (0,): ([1, 2], False), (1,): ([0], False), (0, 1): ([], True), (0, 2): ([], True), (1, 0): ([], True)}
    groups = {r["code_key"]: r["items"] for r in K.code_groups(codes).collect()}
    assert groups == {"0-1": ["a", "c"], "0-2": ["b"], "1-0": ["d"]}
    parts = K.code_groups(codes, max_list=1).orderBy("code_key", "part").collect()
    assert [(r["code_key"], r["part"], r["items"]) for r in parts] == [("0-1", 0, ["a"]), ("0-1", 1, ["c"]), ("0-2", 0, ["b"]), ("1-0", 0, ["d"])]
    wanted = spark.createDataFrame([([0, 1],), ([5, 5],), ([1],)], "code array<int>")
    assert sorted((r["code"], r["items"]) for r in K.lookup_codes(wanted, K.code_groups(codes)).collect()) == [([0, 1], ["a", "c"]), ([1], []), ([5, 5], [])]
    asked = wanted.withColumnRenamed("code", "prefix")
    prefixes = K.prefix_table(codes)
    assert sorted(r["prefix"] for r in K.known_prefixes(asked, prefixes).collect()) == [[0, 1], [1]]
    assert [r["prefix"] for r in K.known_codes(asked, prefixes).collect()] == [[0, 1]]
    assert sorted((r["prefix"], r["next_values"]) for r in K.allowed_next(asked, prefixes).collect()) == [([0, 1], []), ([1], [0]), ([5, 5], [])]


def test_greedy_decode(spark):
    codes = spark.createDataFrame([(0, [0, 1]), (1, [1, 0])], "item_idx int, code array<int>")
    layout = K.TokenLayout((2, 2))
    row = [9.0] * 5 + [1.0, 2.0] + [0.0, 5.0]
    samples = spark.createDataFrame([(0, [row, row])], "id int, logits array<array<double>>")
    assert K.greedy_decode(samples, layout, K.prefix_table(codes)).first()["code"] == [1, 0]
    assert K.greedy_decode(samples, layout).first()["code"] == [1, 1]

    def scorer(state, step):  # prefers to repeat the value chosen before
        same = F.when(F.size("prefix") > 0, F.element_at("prefix", -1)).otherwise(0)
        pair = F.array(F.when(same == 0, 1.0).otherwise(0.0), F.when(same == 1, 1.0).otherwise(0.0))
        return state.withColumn("step_logits", F.concat(F.array_repeat(F.lit(0.0), 5), pair, pair))

    assert K.greedy_decode(samples, layout, None, scorer).first()["code"] == [0, 0]


def test_constrain_logits(spark):
    layout = K.TokenLayout((2, 2))
    rows = [(c, t, float(t), a) for c in (0, 1) for t in range(9) for a in ([], [6, 8])]
    df = spark.createDataFrame(rows, "codebook int, token int, logit double, ok array<int>")
    got = {(r["codebook"], r["token"], len(r["ok"])) for r in K.constrain_logits(df, layout, "ok").collect() if r["logit"] > -1e9}
    assert got == {(0, 5, 0), (0, 6, 0), (1, 7, 0), (1, 8, 0), (0, 6, 2), (1, 8, 2)}


def brute(queries, items, history, target, penalty=None, weight=0.0):
    scores = queries @ items.T
    ranks, tops = [], []
    for q in range(len(queries)):
        s = scores[q] - (weight * penalty if penalty is not None else 0.0)
        keep = [i for i in range(len(items)) if i == target[q] or i not in history[q]]
        ranks.append(1 + sum(s[i] > s[target[q]] for i in keep))
        tops.append(sorted(keep, key=lambda i: (-s[i], i))[:4])
    return ranks, tops


@pytest.mark.parametrize("block,weight", [(R.ITEM_BLOCK_BYTES, 0.0), (R.ITEM_BLOCK_BYTES, 0.3), (300, 0.0), (500, 0.3)])
def test_rank_catalogue_equals_brute_force(spark, block, weight):
    rng = np.random.default_rng(8)
    items = np.round(rng.normal(size=(31, 4)), 2)
    items[7] = items[3]  # equal vectors tie
    q = np.round(rng.normal(size=(40, 4)), 2)
    target = [int(x) for x in rng.integers(31, size=40)]
    history = [[int(x) for x in rng.integers(31, size=3)] for _ in range(40)]
    history[0] = [target[0], 1, 2]  # the target stays a candidate
    penalty = rng.random(31)
    queries = spark.createDataFrame([(i, q[i].tolist(), target[i], history[i], [True] * 3) for i in range(40)], "id int, vec array<double>, target int, history array<int>, mask array<boolean>")
    table = spark.createDataFrame([(i, items[i].tolist(), float(penalty[i])) for i in range(31)], "item_idx int, vec array<double>, penalty double")
    out = R.rank_catalogue(queries, table, ["id"], 4, penalty_weight=weight, temperature=0.5, block_bytes=block)
    got = sorted(out.collect(), key=lambda r: r["id"])
    ranks, tops = brute(q, items, history, target, penalty, weight)
    assert [r["rank"] for r in got] == ranks
    assert [[t["item_idx"] for t in r["top"]] for r in got] == tops
    lse = np.log(np.exp(q @ items.T / 0.5).sum(1))
    np.testing.assert_allclose([r["log_sum_exp"] for r in got], lse)
    masked = R.rank_catalogue(queries.withColumn("mask", F.array_repeat(F.lit(False), 3)), table, ["id"], 4)
    assert [r["rank"] for r in sorted(masked.collect(), key=lambda r: r["id"])] == brute(q, items, [[]] * 40, target)[0]


def test_code_scores(spark):
    codes = spark.createDataFrame([(0, [0, 1]), (1, [1, 0]), (2, [1, 1])], "item_idx int, code array<int>")
    layout = K.TokenLayout((2, 2))
    logits = np.random.default_rng(2).normal(size=(5, 2, 9))
    data = [(i, 1, logits[i].tolist(), [0], [True]) for i in range(5)]
    samples = spark.createDataFrame(data, "id int, target int, logits array<array<double>>, history array<int>, mask array<boolean>")
    out = R.rank_catalogue(code_queries(samples), code_items(codes, layout), ["id"], 3, score="code", exclude_history=False)
    lp = logits - np.log(np.exp(logits).sum(-1, keepdims=True))
    want = np.stack([lp[:, 0, 5] + lp[:, 1, 8], lp[:, 0, 6] + lp[:, 1, 7], lp[:, 0, 6] + lp[:, 1, 8]], 1)
    for r in out.collect():
        assert r["rank"] == 1 + (want[r["id"]] > want[r["id"], 1]).sum()
        np.testing.assert_allclose(r["target_score"], want[r["id"], 1], atol=1e-9)


def test_metrics_golden(spark):
    ranks = spark.createDataFrame([(0, 1), (1, 3), (2, 11)], "target int, rank int")
    m = R.retrieval_metrics(ranks, "1,5").first()
    assert m["mean_rank"] == 5 and all(round(m[f"{x}@1"], 6) == 0.333333 for x in ("hit", "recall", "mrr", "ndcg"))
    assert (round(m["hit@5"], 6), round(m["mrr@5"], 6), round(m["ndcg@5"], 6)) == (0.666667, 0.444444, 0.5)
    groups = spark.createDataFrame([(0, "hot"), (1, "hot"), (2, "cold")], "item_idx int, group string")
    by = {r["group"]: r for r in R.grouped_metrics(ranks, groups, "5").collect()}
    assert {g: r["sample_count"] for g, r in by.items()} == {"overall": 3, "cold": 1, "mid": 0, "hot": 2}
    assert by["hot"]["mean_rank"] == 2 and by["mid"]["hit@5"] is None
    long = R.metrics_long(R.retrieval_metrics(ranks, "5"), [])
    assert long.count() == 6
    scores = spark.createDataFrame([(0, i, s) for i, s in enumerate([0.5, 0.9, 0.5, 0.1])], "id int, item_idx int, score double")
    target = spark.createDataFrame([(0, 2)], "id int, target int")
    assert R.ranks_from_scores(scores, ["id"], target).first()["rank"] == 2
    assert R.limit_batches(spark.range(50).withColumnRenamed("id", "sample_index"), 2, 16).count() == 32


def test_evaluate_and_predictions(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], VEC)
    data = [("test", i, [1.0, 0.0], i % 6, [5, -1], [True, False]) for i in range(12)]
    queries = spark.createDataFrame(data, "split string, id int, vec array<double>, target int, history array<int>, mask array<boolean>")
    out = evaluate(queries, items, queries, ["id"], "1,3")
    best = {r["id"]: r for r in out.ranked.collect()}
    assert best[0]["rank"] == 5 and best[5]["rank"] == 1 and best[4]["rank"] == 1
    assert {r["group"]: r["sample_count"] for r in out.metrics.collect()} == {"overall": 12, "cold": 4, "mid": 4, "hot": 4}
    names = items.select("item_idx", F.concat(F.lit("i"), "item_idx").alias("item_id"))
    r = R.predictions(out.ranked, queries, names, out.groups, ["id"]).filter("id = 4").first()
    assert r["history_items"] == ["i5"] and [t["item_id"] for t in r["retrieved_topk"]] == ["i4", "i3", "i2"]
    assert (r["target_item_id"], r["target_rank"], r["retrieved_topk"][0]["rank"]) == ("i4", 1, 1)
    scored = R.score_queries(queries.drop("vec"), lambda frame: [[float(t), 0.0] for t in frame["target"]])
    assert scored.filter("id = 3").first()["vec"] == [3.0, 0.0]


def test_losses(spark):
    rng = np.random.default_rng(5)
    logits, labels, batch = rng.normal(size=(6, 4)) * 3, [0, 3, -100, 1, 2, 2], [0, 0, 0, 0, 1, 1]
    rows = [(i, t, float(logits[i, t]), labels[i], batch[i]) for i in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, "id int, token int, logit double, label int, batch int")
    lp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    kept = [i for i in range(6) if labels[i] != -100]
    plain = {i: -lp[i, labels[i]] for i in kept}
    smooth = {i: 0.8 * plain[i] - 0.2 * lp[i].mean() for i in kept}
    assert np.isclose(L.masked_cross_entropy(df, ["id"]).first()[0], np.mean(list(plain.values())))
    assert np.isclose(L.masked_cross_entropy(df, ["id"], 0.2).first()[0], np.mean(list(smooth.values())))
    by_batch = np.mean([np.mean([plain[i] for i in kept if batch[i] == b]) for b in (0, 1)])
    assert np.isclose(L.masked_cross_entropy(df, ["id"], 0.0, "batch").first()[0], by_batch)
    got = {(r["id"], r["token"]): r["log_prob"] for r in L.log_softmax_rows(df, ["id"]).collect()}
    np.testing.assert_allclose([got[i, t] for i in range(6) for t in range(4)], lp.reshape(-1))
    arrays = spark.createDataFrame([([1, -100, 2], [1, 5, 0])], "labels array<int>, predicted array<int>")
    assert tuple(L.masked_accuracy(arrays).first()) == (1, 2, 0.5)
    assert L.masked_accuracy(arrays.limit(0)).first()["accuracy"] == 0
    wide = spark.createDataFrame([(logits[0].tolist(),)], "x array<double>").select(L.log_softmax("x").alias("y")).first()["y"]
    np.testing.assert_allclose(wide, lp[0])
    ranked = spark.createDataFrame([(0, 2.0, 1.0), (1, 3.0, 0.5)], "target int, log_sum_exp double, target_score double")
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "item_idx int, weight double")
    assert np.isclose(L.ranking_cross_entropy(ranked, 0.5, weights).first()[0], (0.0 + 2.0 * 3) / 4)
    assert np.isclose(L.ranking_cross_entropy(ranked, 0.5).first()[0], 1.0)


def test_group_summary_keeps_names(spark):
    freq = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "item_idx int, freq bigint")
    out = sorted(map(tuple, P.group_summary(P.popularity_groups(freq)).collect()))
    assert out == [(0, "cold", 1, 1, 1, 1.0), (1, "mid", 1, 2, 2, 2.0), (2, "hot", 1, 9, 9, 9.0)]


def test_attached_branches(spark):
    samples = spark.createDataFrame(
        [(0, [-1, 1, 0], [False, True, True], 1), (1, [-1, -1, -1], [False] * 3, -1), (2, [1, 1, 1], [True, True, False], 0), (3, [], [], 0)],
        "id int, history_item_ids array<int>, history_mask array<boolean>, target_item_ids int",
    )
    text = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 6.0])], "item_idx int, vec array<double>")
    cf = spark.createDataFrame([(0, [5.0]), (1, [7.0])], "item_idx int, vec array<double>")
    out = B.attach_branches(samples, {"text": text, "cf": cf}, ["id"], latents=text)
    assert out.columns == [*samples.columns, *[c for c in B.OPTIONAL_COLUMNS if "image" not in c]]
    got = {r.id: r for r in out.collect()}
    assert got[0].history_text_embeds == [[0, 0], [3, 6], [1, 2]] and got[0].pooled_text_embed == [2, 4] and got[0].pooled_cf_embed == [6]
    assert got[1].history_cf_embeds == [[0]] * 3 and got[1].target_text_embed == got[1].pooled_text_embed == got[1].target_item_latent == [0, 0]
    assert got[2].history_cf_embeds == [[7], [7], [0]] and got[2].target_cf_embed == [5] and got[2].target_item_latent == [1, 2]
    assert got[3].history_text_embeds == [] and got[3].pooled_text_embed == [0, 0]
    assert B.attach_branches(samples.limit(0), {"text": text}, ["id"]).count() == 0
    assert B.attach_branches(samples, {}, ["id"]).columns == samples.columns
    with pytest.raises(Exception, match="no text vector"):
        B.attach_branches(samples, {"text": text.filter("item_idx = 0")}, ["id"]).collect()
    with pytest.raises(ValueError, match="audio"):
        B.attach_branches(samples, {"audio": text}, ["id"])
