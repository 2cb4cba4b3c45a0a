"""Linked vectors against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import vector_links

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute_force(rows, cosine=0.98):
    fine = [
        label is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and any(v)
        for _, v, label in rows
    ]
    links = {i: set() for i in range(len(rows))}
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if fine[i] and fine[j] and label == other and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=str)


def answers(spark, rows, cosine=0.98):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("node", F.lit(1)).withColumn("size", F.lit("x"))
    got = vector_links.linked_vectors(table, cosine).select("vec_id", "n_links", "component_id", "kept")
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(seed, dim, n, spread):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((max(1, n // 12), dim))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    rows = []
    for i in range(n):
        c = centers[rng.integers(0, len(centers))]
        v = c + rng.standard_normal(dim) * rng.uniform(0, spread) / np.sqrt(dim)
        rows.append((i, (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("dim, cosine, spread", [(64, 0.98, 0.3), (8, 0.9, 0.7), (2, 0.995, 0.4)])
def test_links_match_brute_force(spark, dim, cosine, spread):
    rows = clusters(dim, dim, 400, spread)
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(20)]
    assert answers(spark, rows, cosine) == brute_force(rows, cosine)


def test_full_cells_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "_BLOCK", 7)
    monkeypatch.setattr(vector_links, "_PAIRS", 50)
    rows = clusters(2, 16, 200, 0.25)
    assert answers(spark, rows) == brute_force(rows)


def test_odd_vectors_ids_and_labels(spark):
    v, w = [3.0, 4.0, 0.0], [3.0, 4.0, 0.1]
    rows = [
        (1, v, 0), (2, w, 0), (2, w, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [3.0, None, 0.0], 0),
        (9, [float("nan"), 4.0, 0.0], 0), (10, [float("inf"), 4.0, 0.0], 0), (11, [3.0, 4.0], 0), (12, [-3.0, -4.0, 0.0], 0), (None, v, 0),
        (None, [0.0, 0.0, 1.0], 2), (13, [3e300, 4e300, 0.0], 0), (14, [3e-200, 4e-200, 0.0], 0),
    ]
    got = answers(spark, rows)
    expected = brute_force(rows)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert vector_links.linked_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_plan_loses_few_pairs_at_the_threshold():
    plan = vector_links.Plan()
    assert plan.least < plan.size and plan.reach > 0.5
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((20_000, 32))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    hit = np.abs(plan.steps(x).astype(int) - plan.steps(near)) <= vector_links._WINDOW
    groups = hit[:, :12].reshape(-1, 3, 4).all(2).any(1)
    assert groups.all() and (hit.sum(1) >= plan.least).all()
    with pytest.raises(ValueError):
        vector_links.Plan(cosine=1.0)
