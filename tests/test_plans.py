import importlib.util
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators.gather import item_names
from seqloom.plans.evaluate import evaluate, pooled_queries
from seqloom.plans.prepare import prepare
from seqloom.plans.semantic_ids import build_semantic_ids
from seqloom.session import release, shared_root
from seqloom.sources.sinks import write_tokenized


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(6)
    data = [(f"u{rng.integers(25)}", f"i{rng.integers(20)}", int(t)) for t in range(500)]
    p = prepare(spark.createDataFrame(data, "user_id string, item_id string, ts bigint"), 3)
    n = p.item_map.count()
    vec = lambda seed: spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, 8)))], "item_idx int, vec array<double>"
    )
    ids = build_semantic_ids({"text": vec(1), "cf": vec(2)}, p.item_map, method="pq", subspaces=2, codebook_size=4, iterations=3)
    samples = p.samples(5)
    manifest = write_tokenized(ids.tokenize(samples, 5), str(tmp_path / "t"), ids.layout)
    assert sum(s["num_samples"] for s in manifest["splits"].values()) == samples.count()
    assert manifest["splits"]["test"]["max_seq_len"] == 1 + 5 * 3 + 2 + 1
    test = samples.filter("split = 'test'")
    out = evaluate(pooled_queries(test, vec(1), ["user_idx", "pos"]), vec(1), samples.filter("split = 'train'"), ["user_idx", "pos"])
    by = {r["group"]: r["sample_count"] for r in out.metrics.collect()}
    assert by["overall"] == test.count() == by["cold"] + by["mid"] + by["hot"]
    hits = out.metrics.filter(F.col("group") == "overall").first()
    assert hits["hit@5"] <= hits["hit@10"] <= hits["hit@20"]
    assert out.ranked.filter((F.col("rank") < 1) | (F.col("rank") > n)).isEmpty()
    named = item_names(samples, p.item_map, ["user_idx", "pos"])
    lookup = {r["item_idx"]: r["item_id"] for r in p.item_map.collect()}
    assert all(r["history_items"] == [lookup[i] for i in r["history"] if i >= 0] for r in named.collect())
    with pytest.raises(ValueError):
        build_semantic_ids({"text": vec(1).filter("item_idx > 0")}, p.item_map)


def test_every_query_is_declared_with_its_twin():
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(names) and len(names) > 90
    # The optional text operators, which SQL mostly cannot express, have their own tests.
    own = [q.name for q in entry.all_queries()]
    assert len([name for name in own if name not in twins]) < 16


def test_release_removes_the_written_tables(spark):
    folder = os.path.join(shared_root(spark), f"seqloom-{spark.sparkContext.applicationId}").removeprefix("file:")
    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)
