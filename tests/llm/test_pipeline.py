"""Stages of the pipeline on odd tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import common, exact, minhash

SF = "/root/testdata/sf0.001"


def prose(seed, n=60):
    return " ".join(f"w{x}q" for x in np.random.default_rng(seed).integers(0, 400, n))


def near(seed, changed):
    words = prose(seed).split()
    for k in range(changed):
        words[7 * k + 3] = f"other{k}"
    return " ".join(words)


ROWS = [
    (5, "z q"), (5, "z q"), (7, "z q"), (3, "z q"), (3, prose(1)), (None, prose(1).upper()), (None, None), (8, None), (9, ""), (9, " \n"),
    (11, prose(2)), (12, near(2, 1)), (12, near(2, 1)), (None, near(2, 2)), (13, prose(3)), (13, prose(4)), (14, "x" * 70_000), (15, "x" * 70_000 + " y"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    rows = [(k, t, "en", "s", 1) for k, t in ROWS]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table = table.withColumn("score", F.lit(2.0)).withColumn("_text", F.lit("t")).withColumn("_file", F.lit(3)).withColumn("_metadata", F.lit("m"))
    table.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_row_keys_tell_rows_apart(spark, odd):
    for table in (odd, odd.filter("doc_id > 3"), odd.unionByName(odd), odd.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))):
        keyed, names = common.with_row_keys(table)
        assert keyed.columns[: len(table.columns)] == table.columns
        assert keyed.select(*names).distinct().count() == table.count() > 0


def test_exact_stage_keeps_one_row_of_equal_texts(spark, odd):
    out = corpus_pipeline.drop_exact_copies(spark, odd, SF)
    assert out.columns == odd.columns
    kept = [(r["doc_id"], folded(r["text"])) for r in out.collect()]
    assert sorted(t for _, t in kept) == sorted({folded(t) for _, t in ROWS})
    for key, text in kept:
        ids = [k for k, t in ROWS if folded(t) == text and k is not None]
        assert key == (max(ids) if ids else None)


def test_near_stage_keeps_one_row_of_a_component(spark, odd):
    out = corpus_pipeline.drop_near_copies(spark, odd, SF)
    assert out.columns == odd.columns
    sets = [minhash.shingle_set((t or "").encode(), 5) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common_ >= 80 * (len(sets[i]) + len(sets[j]) - common_):
                group = [group[j] if g == group[i] else g for g in group]
    expected = []
    for g in set(group):
        ids = [ROWS[k][0] for k in range(len(ROWS)) if group[k] == g]
        expected.append(min((i for i in ids if i is not None), default=None))
    assert sorted(map(str, expected)) == sorted(str(r["doc_id"]) for r in out.collect())


def test_every_stage_takes_odd_and_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, odd.limit(0), SF).collect() == []
        if name == "best_fit_packing":
            assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() >= len(ROWS)
        else:
            assert out.columns == odd.columns
            before, after = ([tuple(map(str, r)) for r in x.collect()] for x in (odd, out))
            assert all(after.count(r) <= before.count(r) for r in after) and len(after) > 0


def test_clean_rows_stay_beside_a_leak_of_the_same_id(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"{prose(5)} {item} {prose(6)}"), (1, prose(7)), (None, item), (None, prose(8))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.drop_benchmark_leaks(spark, spark.read.parquet(f"{tmp_path}/docs"), SF)
    assert sorted(r["text"] for r in out.collect()) == sorted([prose(7), prose(8)])


def test_equal_chunk_hashes_with_row_columns(spark):
    """Chunks that only share a short hash are told apart, and the row columns stay with their rows."""
    texts = [prose(k, 900) for k in range(12)] + [prose(0, 900).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("place", F.col("doc_id") * 7)
    out = exact.exact_duplicates(docs, row=["place"], hash_bytes=1).collect()
    assert {r["place"]: (r["group_size"], r["kept"]) for r in out} == {7 * k: (2 if k in (0, 12) else 1, k != 0) for k in range(13)}
