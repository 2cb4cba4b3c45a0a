import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from seqloom.operators import popularity as P, samples as S
from seqloom.operators.cooccurrence import cooccurrence, skipgram_pairs, sppmi
from seqloom.operators.kcore import k_core
from seqloom.operators.ordering import dense_index, last_at_or_before, number_rows, running_totals
from seqloom.operators.sequences import build_samples, context_pairs, number_positions, sequence_arrays
from seqloom.plans.prepare import prepare

CORE = [("u1", "a", 1), ("u1", "b", 2), ("u2", "a", 1), ("u2", "b", 3), ("u3", "b", 1), ("u3", "c", 2), ("u4", "c", 1), ("u1", "a", 5)]
SCHEMA = "user_id string, item_id string, ts bigint"


def naive_core(rows, k):
    while True:
        users, items = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
        kept = [r for r in rows if users[r[0]] >= k and items[r[1]] >= k]
        if len(kept) == len(rows):
            return kept
        rows = kept


def test_k_core_golden(spark, rows):
    out = k_core(spark.createDataFrame(CORE, SCHEMA), 2)
    assert rows(out.interactions, "user_id", "item_id", "ts") == [
        ("u1", "a", 1), ("u1", "a", 5), ("u1", "b", 2), ("u2", "a", 1), ("u2", "b", 3)
    ]
    assert out.trace == [(1, 8, 7, 4, 3), (2, 7, 6, 3, 3), (3, 6, 5, 3, 2), (4, 5, 5, 2, 2)]
    assert out.max_user_rows == 3
    assert rows(out.users, "user_id") == [("u1",), ("u2",)]
    assert rows(out.items, "item_id") == [("a",), ("b",)]


def test_k_core_can_become_empty_and_can_be_bounded(spark):
    df = spark.createDataFrame(CORE, SCHEMA)
    assert k_core(df, 4).interactions.isEmpty()
    with pytest.raises(RuntimeError):
        k_core(df, 2, max_iterations=2)
    with pytest.raises(ValueError):
        prepare(df, 4)
    with pytest.raises(ValueError):
        prepare(spark.createDataFrame([], SCHEMA), 2)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(2, 4))
def test_k_core_equals_naive_loop(spark, seed, k):
    rng = random.Random(seed)
    data = [(f"u{rng.randrange(30) ** 2 // 30}", f"i{rng.randrange(25)}", rng.randrange(5)) for _ in range(110)]
    out = k_core(spark.createDataFrame(data, SCHEMA), k).interactions
    assert sorted(map(tuple, out.select("user_id", "item_id", "ts").collect())) == sorted(naive_core(data, k))


def test_k_core_rewrites_rows_when_most_are_gone(spark):
    # A chain that unravels one link per round, so that rows are rewritten on the way.
    data = [(f"u{i}", f"i{i}", 0) for i in range(12)] + [(f"u{i}", f"i{i + 1}", 0) for i in range(12)]
    data += [(u, i, 1) for u in ("x", "y") for i in ("p", "q")]
    out = k_core(spark.createDataFrame(data, SCHEMA), 2)
    assert sorted(map(tuple, out.interactions.select("user_id", "item_id", "ts").collect())) == sorted(naive_core(data, 2))
    assert len(out.trace) > 4


def test_dense_index_order(spark, rows):
    ids = ["b", "B", "a", "ä", "10", "9", "a", "z"]
    out = dense_index(spark.createDataFrame([(x,) for x in ids], "k string").repartition(3), "k", "i")
    assert rows(out, "i", "k") == list(enumerate(sorted(set(ids))))
    assert dict(out.dtypes)["i"] == "int"


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_numbering_and_totals_do_not_depend_on_partitions(spark, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select((F.col("id") * 7919 % 500).cast("int").alias("k"), (F.col("id") % 13).alias("v"))
        numbered = number_rows(df.repartition(5), ["v", "k"], "n")
        want = sorted((r["v"], r["k"]) for r in df.collect())
        assert [r[1:] for r in rows(numbered, "n", "v", "k")] == want
        got = rows(running_totals(df, "k", ["v"], block_rows=32), "k", "v", "v_before")
        total = 0
        for k, v, before in got:
            assert before == total
            total += v
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_as_of_lookup(spark):
    marks = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 3, "c")], "g int, x bigint, name string")
    probes = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate([(1, 0), (1, 4), (1, 5), (1, 99), (2, 3), (2, 4)])], "id int, g int, x bigint")
    out = last_at_or_before(probes, marks, ["g", "x"], "name", "id")
    assert sorted((r["id"], r["name"]) for r in out.collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")]


def positions_of(spark, sequences):
    data = [(u, item, pos) for u, seq in enumerate(sequences) for pos, item in enumerate(seq)]
    return number_positions(spark.createDataFrame(data, "user_idx int, item_idx int, ts bigint"))


def test_samples_golden(spark, rows):
    out = build_samples(positions_of(spark, [[0, 1, 2, 3], [7, 8], [9]]), 2)
    assert rows(out, "user_idx", "pos", "split", "history", "mask", "target") == [
        (0, 1, "train", [-1, 0], [False, True], 1),
        (0, 2, "val", [0, 1], [True, True], 2),
        (0, 3, "test", [1, 2], [True, True], 3),
        (1, 1, "test", [-1, 7], [False, True], 8),
    ]
    assert {r[0] for r in rows(build_samples(positions_of(spark, [[0, 1, 2]]), 2, "none"), "split")} == {"train"}
    with pytest.raises(ValueError):
        build_samples(positions_of(spark, [[0]]), 0)


def test_ties_are_ordered_by_item(spark):
    data = [(0, 5, 1), (0, 2, 1), (0, 2, 1), (0, 9, 0)]
    out = number_positions(spark.createDataFrame(data, "user_idx int, item_idx int, ts bigint"))
    assert [r["items"] for r in sequence_arrays(out).collect()] == [[9, 2, 2, 5]]


def test_long_users_take_another_way_to_the_same_rows(spark):
    rng = random.Random(1)
    data = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(9), rng.randrange(50)) for _ in range(600)]
    df = spark.createDataFrame(data, "user_idx int, item_idx int, ts bigint").repartition(5)
    short, long = number_positions(df), number_positions(df, max_group_rows=50)
    assert long.exceptAll(short).isEmpty() and short.exceptAll(long).isEmpty()
    a, b = build_samples(short, 7), build_samples(long, 7, block_rows=16)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    c, d = context_pairs(short, 3), context_pairs(long, 3, block_rows=5)
    assert c.exceptAll(d).isEmpty() and d.exceptAll(c).isEmpty()


def test_counts_plan_and_chunks(spark, rows):
    positions = positions_of(spark, [list(range(n)) for n in (1, 2, 3, 6, 9)])
    sizes = S.user_sizes(positions)
    counts = S.split_counts(sizes)
    assert rows(counts, "split", "raw_count") == [("test", 4), ("train", 9), ("val", 3)]
    assert rows(S.split_counts(sizes, "none"), "split", "raw_count") == [("train", 16)]
    samples = build_samples(positions, 3)
    for drop_tail in (False, True):
        chunks = S.assign_chunks(samples, sizes, chunk_size=2, drop_tail=drop_tail)
        want = {}
        for split in ("train", "val", "test"):
            picked = sorted((r["user_idx"], r["pos"]) for r in samples.filter(F.col("split") == split).collect())
            for n, key in enumerate(picked[: len(picked) // 2 * 2] if drop_tail else picked):
                want[(split, *key)] = (n // 2, n % 2)
        got = {(r["split"], r["user_idx"], r["pos"]): (r["chunk_id"], r["slot"]) for r in chunks.collect()}
        assert got == want


def test_write_plan_golden(spark, rows):
    counts = spark.createDataFrame([("train", 2500)], "split string, raw_count bigint")
    cols = ("samples_to_write", "full_chunks", "dropped_tail")
    assert rows(S.write_plan(counts, drop_tail=True), *cols) == [(2000, 2, 500)]
    assert rows(S.write_plan(counts, max_samples=1500, drop_tail=True), *cols) == [(1000, 1, 1500)]
    assert rows(S.write_plan(counts), *cols, "chunks") == [(2500, 2, 0, 3)]
    assert rows(S.write_plan(counts, max_samples=1500), *cols, "chunks") == [(1500, 1, 1000, 2)]
    assert S.sample_bytes(50) == 258


def freq_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "item_idx int, freq bigint")


def test_popularity_goldens(spark, rows):
    freq = freq_of(spark, [5, 0, 2, 2, 7, 1, 0, 2])
    for strategy in P.STRATEGIES:
        assert [g for _, g in rows(P.popularity_groups(freq, strategy), "item_idx", "group_id")] == [2, 0, 1, 1, 2, 0, 0, 1]
    q = P.frequency_quantiles(freq).first()
    assert (round(q["q33"], 6), round(q["q66"], 6)) == (1.333333, 2.0)
    with pytest.raises(ValueError):
        P.popularity_groups(freq, "nope")
    empty_mid = P.popularity_groups(freq_of(spark, [1, 1, 1]), "quantile_frequency")
    assert [r[1] for r in rows(P.group_summary(empty_mid), "group_id", "num_items")] == [3, 0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7])
def test_equal_groups_sizes(spark, rows, n):
    groups = [g for _, g in rows(P.popularity_groups(freq_of(spark, range(n))), "item_idx", "group_id")]
    sizes = [groups.count(g) for g in range(3)]
    assert sizes == [n // 3 + (i < n % 3) for i in range(3)] and groups == sorted(groups)


def test_weights_penalty_and_noise_goldens(spark, rows):
    freq = freq_of(spark, [0, 1, 3])
    assert [round(w, 6) for _, w in rows(P.inverse_frequency_weights(freq), "item_idx", "weight")] == [1.656854, 1.171573, 0.828427]
    assert [round(w, 6) for _, w in rows(P.popularity_penalty(freq), "item_idx", "penalty")] == [0.0, 0.5, 1.0]
    assert [w for _, w in rows(P.popularity_penalty(freq_of(spark, [0, 0])), "item_idx", "penalty")] == [0.0, 0.0]
    noise = P.noise_distribution(freq_of(spark, [3, 0, 1]))
    assert [round(p, 6) for _, p in rows(noise, "item_idx", "prob")] == [0.532656, 0.233672, 0.233672]


def test_cooccurrence_goldens(spark, rows):
    positions = positions_of(spark, [[0, 1, 2], [1, 2, 1]])
    one = cooccurrence(positions, 1)
    assert rows(one, "item_i", "item_j", "weight") == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 3.0)]
    assert {round(v, 6) for _, _, v in rows(sppmi(one), "item_i", "item_j", "sppmi")} == {0.693147}
    two = cooccurrence(positions, 2)
    assert rows(two, "item_i", "item_j", "weight") == [
        (0, 1, 1.0), (0, 2, 0.5), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 3.0), (2, 0, 0.5), (2, 1, 3.0)
    ]
    scored = {(i, j): round(v, 6) for i, j, v in rows(sppmi(two, keep_zeros=True), "item_i", "item_j", "sppmi")}
    assert scored[0, 1] == 0.287682 and scored[1, 2] == 0.538997 and scored[0, 2] == scored[1, 1] == 0.0
    assert skipgram_pairs(positions, 1).count() == 8
    with pytest.raises(ValueError):
        sppmi(two, 0.5)


def test_prepare_end_to_end(spark, rows):
    p = prepare(spark.createDataFrame(CORE, SCHEMA), 2)
    assert rows(p.user_map, "user_idx", "user_id") == [(0, "u1"), (1, "u2")]
    assert rows(p.samples(2), "user_idx", "pos", "history", "target") == [
        (0, 1, [-1, 0], 1), (0, 2, [0, 1], 0), (1, 1, [-1, 0], 1)
    ]
