"""Periodic runs against brute force, and their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqloom.llm import periodic, queries


def brute_force(words, least=24, repeats=3):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                out.append((i, j - i + q, q))
            i = j
    smallest = [r for r in out if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in out)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def planted(rng):
    """Noise with runs of all kinds of periods, some inside others."""
    parts = []
    for _ in range(int(rng.integers(1, 5))):
        parts.append(rng.integers(0, 40, int(rng.integers(0, 60))))
        period = int(rng.integers(1, 90))
        unit = rng.integers(0, int(rng.integers(1, 30)), period)
        if rng.random() < 0.4:
            unit = np.concatenate([np.tile(unit[: max(1, period // 4)], 5), unit])
        parts.append(np.tile(unit, 7)[: int(len(unit) * rng.uniform(2, 7))])
    return np.concatenate(parts)


def test_runs_of_many_texts_match_brute_force():
    rng = np.random.default_rng(8)
    texts = [planted(rng) for _ in range(150)] + [np.zeros(0, int), np.zeros(700, int), np.arange(90) % 2, np.arange(23) % 1]
    fibonacci = [0, 1]
    while len(fibonacci) < 900:
        fibonacci = fibonacci + [c for c in fibonacci[: int(len(fibonacci) * 0.618) + 1]]
    texts += [np.array(fibonacci), np.array([bin(i).count("1") % 2 for i in range(600)])]
    found = periodic.find_runs(texts)
    assert [brute_force(t.tolist()) for t in texts] == found
    assert {q for own in found for _, _, q in own} >= {1, 2} and max(q for own in found for *_, q in own) > 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 5))
def test_small_alphabets_and_short_limits(words, short):
    own = np.array(words, np.int64)
    assert periodic.find_runs([own, own], 4, 3, short) == [brute_force(words, 4)] * 2


def test_a_long_text_of_repeats_takes_linear_time():
    unit = np.random.default_rng(1).integers(0, 5000, 40_000)
    text = np.concatenate([np.tile(unit, 4), np.zeros(200_000, np.int64), np.tile(unit[:777], 300)])
    runs = periodic.find_runs([text])[0]
    assert {(q, n) for _, n, q in runs} >= {(1, 200_000)} and {40_000, 777} <= {q for *_, q in runs}


def test_operator_on_odd_rows(spark):
    run = "a B a b " * 20
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, run), (4, run), (None, "x " * 30), (6, "x\x0b" * 23), (7, "é ü\r\n" * 9 + "w" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("words", F.lit("x"))
    got = periodic.periodic_runs(docs).collect()
    expected = []
    for key, text in rows:
        words = (text or "").split()
        runs = brute_force(words, 24)
        expected.append((key, len(words), runs, collapse(words, runs)))
    order = lambda r: (str(r[0]), r[1])
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=order) == sorted(expected, key=order)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs([], repeats=2)


def test_query_matches_its_rule(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(0, 300))))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "solo " * 40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for key, text in rows:
        own = (text or "").split()
        words, n = own, len(own)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute_force(words)
        r = got[key]
        assert r["n_runs"] == len(runs)
        if runs:
            best = max(runs, key=lambda x: (x[1] * 1000 // x[2], -x[0], -x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert changed > 5
