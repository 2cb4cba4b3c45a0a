"""Spelling variants against brute force, and their edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, least=7, ratio=10):
    words = {w: n for w, n in counts.items() if w is not None and len(w) >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def variants(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("size", F.lit(1)).withColumn("a", F.lit("x"))
    got = spelling.spelling_variants(words, **options)
    return {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def made_counts(seed, n, alphabet="abcé"):
    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(n):
        word = "".join(rng.choice(list(alphabet), rng.integers(2, 6))) + "stemming"[: rng.integers(2, 8)]
        out[word] = int(10 ** rng.uniform(0.4, 5))
        for _ in range(3):
            at = int(rng.integers(0, len(word)))
            kind = rng.integers(0, 3)
            letter = str(rng.choice(list(alphabet)))
            changed = word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 1) :]
            out.setdefault(changed, int(10 ** rng.uniform(0.4, 3)))
    return out


@pytest.mark.parametrize("least", [2, 7])
def test_pairs_forms_and_roots_match_brute_force(spark, least):
    counts = made_counts(least, 120)
    got = variants(spark, counts, least_length=least)
    assert got == brute_force(counts, least)
    assert any(root not in (word, form) for word, form, root, *_ in got if form)


def test_hot_chunks_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_BLOCK", 3)
    counts = made_counts(5, 60, "ab")
    assert variants(spark, counts, least_length=3) == brute_force(counts, 3)


def test_ties_nulls_short_words_and_empty_tables(spark):
    counts = {"aaaaaaa": 100, "aaaaaab": 100, "aaaaaac": 10, "aaaaaad": 11, None: 4, "short": 9, "zzzzzzzz": 1}
    got = {r[0]: r for r in variants(spark, counts)}
    assert got["aaaaaac"][1:] == ("aaaaaaa", "aaaaaaa", 10, 3, 100)
    assert got["aaaaaad"][1:] == (None, "aaaaaad", 11, 3, None)
    assert got["zzzzzzzz"][1:] == (None, "zzzzzzzz", 1, 0, None)
    assert len(got) == 5
    assert variants(spark, {}) == set()
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n bigint"), least_length=1)


def test_typed_words_follow_the_rule(spark):
    texts = ["Überraschung ELEPHANT-elephants x2 garçonne×÷", None, "", "zebra " * 4, "Łódzkiej naïvetés " + "elephants " * 50]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts * 9)]
    rows = [(None if i is None else k, t) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit(1)).withColumn("h", F.lit(2))
    expected = []
    letters = lambda c: "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"
    for key, text in rows:
        for run in "".join(c if letters(c) else " " for c in text or "").split(" "):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected.append(run)
    got = [r[0] for r in queries.typed_words(docs).collect()]
    assert sorted(w for w in got if len(w) >= 7) == sorted(w for w in expected if len(w) >= 7)
    assert any(w in got for w in ("elephant"[:i] + "elephant"[i + 1 :] for i in range(8))) or len(set(expected)) > 3
