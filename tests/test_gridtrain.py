"""Grid training: visits, negatives, split ids, and independence from partitioning."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.operators import gridtrain as G


def frames(spark, pairs, n_left, n_right):
    table = spark.createDataFrame(pairs, "left bigint, right bigint, n bigint")
    ids = lambda n: spark.range(n).select("id", (F.col("id") * 0.1 + 1).alias("mass"))
    return table, ids(n_left), ids(n_right)


def vectors(df):
    return np.array([r["vec"] for r in df.orderBy("id").collect()])


def test_visits_take_every_copy_once():
    counts = np.array([3, 1, 50, 0, 7])
    seen = np.concatenate(list(G._visits(counts, 4, np.random.default_rng(0))))
    assert np.bincount(seen, minlength=5).tolist() == counts.tolist()


def test_drawn_items_are_lacking_and_evenly_drawn():
    left = np.repeat(np.arange(3), [2, 9, 10])
    right = np.concatenate([[0, 5], np.arange(9), np.arange(10)])
    lacking = G._Lacking(left, right, 10)
    asked = np.tile([0, 1, 2], 4000)
    got = lacking.draw(asked, np.random.default_rng(1))
    assert set(got[asked == 1]) == {9} and set(got[asked == 2]) == {-1}
    share = np.bincount(got[asked == 0], minlength=10) / 4000
    assert share[0] == share[5] == 0 and np.allclose(share[[1, 2, 3, 4, 6, 7, 8, 9]], 1 / 8, atol=0.02)


@pytest.mark.parametrize("loss", ["ranking", "skipgram"])
def test_the_result_depends_on_seed_and_rows_only(spark, loss):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)): int(c) for a, b, c in rng.integers(0, 12, (60, 3)) + [0, 0, 1]}.items())
    rows = [(a, b, n) for (a, b), n in pairs] + [(3, 14, 4000)]  # one id holds nearly all observations
    table, lefts, rights = frames(spark, rows, 12, 16)
    settings = G.Training(loss, 5, epochs=2, negatives=2, seed=4, blocks=3)
    one = [vectors(x) for x in G.train_factors(table, lefts, rights, settings)]
    two = [vectors(x) for x in G.train_factors(table.repartition(7), lefts.repartition(2), rights, settings)]
    for a, b in zip(one, two):
        np.testing.assert_allclose(a, b, atol=1e-9)
        assert a.shape[1] == 5 and np.isfinite(a).all()
    other = vectors(G.train_factors(table, lefts, rights, G.Training(loss, 5, epochs=2, negatives=2, seed=5, blocks=3))[0])
    assert np.abs(other - one[0]).max() > 1e-3


def test_a_round_changes_met_rows_only(spark):
    t = G.Training("ranking", 2, seed=1)
    side = lambda kind, ids, last: [(0, kind, i, 0, None, None, [0.1 * i, 0.2, last], 0.0, 1.0) for i in ids]
    rows = side(0, [1, 2], 1.0) + side(1, [5, 6, 7], 0.0) + [(0, 2, 1, 0, 5, 3, None, None, None), (0, 2, 1, 0, 6, 1, None, None, None)]
    names = ["cell", "kind", "id", "part", "other", "n", "vec", "moved", "mass"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
    out = {(r["kind"], r["id"]): r for r in G._train_cell(t, (0, 0, 0), 1)((pa.scalar(0),), table).to_pylist()}
    assert out[0, 2]["vec"] == [0.2, 0.2, 1.0] and out[0, 2]["moved"] == 0
    assert out[0, 1]["vec"][2] == 1.0 and out[0, 1]["moved"] > 0
    assert out[1, 5]["vec"][2] > 0 > out[1, 7]["vec"][2]  # the observed item's bias rises, the lacking one's falls


def test_ids_without_pairs_keep_their_draw_and_empty_pairs_are_legal(spark):
    table, lefts, rights = frames(spark, [], 3, 4)
    left, right = G.train_factors(table, lefts, rights, G.Training("ranking", 4, epochs=1, blocks=2))
    assert vectors(left).shape == (3, 4) and 0 < np.abs(vectors(right)).max() < 0.2
    with pytest.raises(ValueError):
        G.Training("nope", 4)
    with pytest.raises(ValueError):
        G.Training("ranking", 0)
