"""Full-catalogue retrieval with the pooled-history baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.behaviour import click_samples
from catalog.spec import Query
from catalog.tables import vectors
from catalog.vectors import STEPS
from seqloom.functions import vector as V
from seqloom.operators import losses as Lo, popularity as P, retrieval as R
from seqloom.plans.evaluate import evaluate, pooled_queries
from seqloom.session import materialize

KEY = ["user_idx", "pos"]
LAMBDA, TAU = 0.05, 0.1

FREQ = (
    "freq AS (SELECT vec_id AS item_idx, count(target) AS freq FROM embeddings LEFT JOIN "
    "(SELECT target FROM samples WHERE split = 'train') ON target = vec_id GROUP BY vec_id)"
)
GROUPED = "grouped AS (SELECT item_idx, ['cold', 'mid', 'hot'][ntile(3) OVER (ORDER BY freq, item_idx)] AS grp FROM freq)"
QUERY_VECTORS = (
    *STEPS,
    "q AS MATERIALIZED (SELECT user_idx, pos, target, list(value ORDER BY dim) AS vec FROM pooled GROUP BY ALL)",
    "items AS MATERIALIZED (SELECT vec_id AS item_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
)


def _scored(penalised: bool) -> tuple[str, ...]:
    score = "list_dot_product(q.vec, i.vec)"
    if penalised:
        score += f" - {LAMBDA} * (SELECT ln(1 + freq) FROM freq f WHERE f.item_idx = i.item_idx) / (SELECT max(ln(1 + freq)) FROM freq)"
    return (
        *QUERY_VECTORS,
        FREQ,
        f"scores AS MATERIALIZED (SELECT user_idx, pos, target, item_idx, round({score}, 10) AS score FROM q, items i)",
        "best AS (SELECT user_idx, pos, score AS own FROM scores WHERE item_idx = target)",
        "offered AS (SELECT c.* FROM scores c JOIN samples s USING (user_idx, pos) WHERE c.item_idx = c.target OR NOT list_contains(s.past, c.item_idx))",
        "ranks AS MATERIALIZED (SELECT user_idx, pos, target, own, count(*) FILTER (WHERE score > own) + 1 AS rank "
        "FROM offered JOIN best USING (user_idx, pos) GROUP BY ALL)",
        GROUPED,
    )


def _measures(ks=(5, 10, 20)) -> str:
    parts = ["count(rank) AS sample_count", "avg(rank) AS mean_rank"]
    for k in ks:
        hit = f"avg(CASE WHEN rank <= {k} THEN 1.0 WHEN rank IS NOT NULL THEN 0.0 END)"
        parts += [
            f'{hit} AS "hit@{k}"', f'{hit} AS "recall@{k}"',
            f'avg(CASE WHEN rank <= {k} THEN 1.0 / rank WHEN rank IS NOT NULL THEN 0.0 END) AS "mrr@{k}"',
            f'avg(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1) WHEN rank IS NOT NULL THEN 0.0 END) AS "ndcg@{k}"',
        ]
    return ", ".join(parts)


MEASURES = "sample_count:i mean_rank:f " + " ".join(f"{m}@{k}:f" for k in (5, 10, 20) for m in ("hit", "recall", "mrr", "ndcg"))
NAMES = [part.split(":")[0] for part in MEASURES.split()]
BY_GROUP = (
    f"SELECT 'overall' AS \"group\", {_measures()} FROM ranks UNION ALL SELECT g, {_measures()} FROM "
    "(SELECT unnest(['cold', 'mid', 'hot']) AS g) LEFT JOIN (SELECT grp, rank FROM ranks JOIN grouped ON item_idx = target) ON grp = g GROUP BY g"
)


def _run(spark, d, penalty: float = 0.0, strategy: str = "equal_items"):
    samples, items = materialize(click_samples(spark, d), "samples"), vectors(spark, d)  # read twice
    queries = pooled_queries(samples, items, KEY)
    train = samples.filter("split = 'train'")
    return evaluate(queries, items, train, KEY, "5,10,20", strategy, penalty, held=0)


def _ranked(spark, d, **kw):
    samples, items = click_samples(spark, d), vectors(spark, d)
    return R.rank_catalogue(pooled_queries(samples, items, KEY), items, KEY, **kw)


def _predictions(spark, d):
    samples, items = click_samples(spark, d), vectors(spark, d)
    names = items.select("item_idx", F.concat(F.lit("i"), "item_idx").alias("item_id"))
    groups = P.popularity_groups(P.target_frequency(samples.filter("split = 'train'"), names))
    out = R.predictions(_ranked(spark, d, k=10), samples, names, groups, KEY)
    return out.withColumn("retrieved", F.col("retrieved_topk.item_id"))


def _ranking_loss(spark, d):
    samples, items = materialize(click_samples(spark, d), "samples"), vectors(spark, d)  # read twice
    unit = items.select("item_idx", V.l2_normalize("vec").alias("vec"))
    ranked = R.rank_catalogue(
        pooled_queries(samples, items, KEY, normalize=True), unit, KEY, k=0, exclude_history=False, temperature=TAU
    )
    weights = P.inverse_frequency_weights(P.target_frequency(samples.filter("split = 'train'"), items))
    return Lo.ranking_cross_entropy(ranked, TAU, weights)


def _limited(spark, d):
    samples = click_samples(spark, d).filter("split = 'test'").withColumn("sample_index", F.col("user_idx"))
    items = vectors(spark, d)
    few = R.limit_batches(samples, 3, 16)
    return R.retrieval_metrics(R.rank_catalogue(pooled_queries(few, items, KEY), items, KEY, k=0))


QUERIES = [
    Query(
        "retrieval_ranks", "user_idx:i pos:i target:i target_score:f rank:i", lambda s, d: _ranked(s, d, k=0),
        "SELECT user_idx, pos, target, own AS target_score, rank FROM ranks", _scored(False),
    ),
    Query(
        "retrieval_topk", "user_idx:i pos:i place:i item_idx:i score:f",
        lambda s, d: _ranked(s, d).select(*KEY, F.posexplode("top").alias("place", "t")).select(*KEY, "place", "t.item_idx", "t.score"),
        "SELECT user_idx, pos, place, item_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY user_idx, pos "
        "ORDER BY score DESC, item_idx) - 1 AS place FROM offered) WHERE place < 20",
        _scored(False),
    ),
    Query(
        "retrieval_metrics", MEASURES, lambda s, d: R.retrieval_metrics(_ranked(s, d, k=0)),
        f"SELECT {_measures()} FROM ranks", _scored(False),
    ),
    Query(
        "retrieval_by_group", "group:s " + MEASURES, lambda s, d: _run(s, d).metrics,
        BY_GROUP,
        _scored(False),
    ),
    Query(
        "retrieval_penalized", "user_idx:i pos:i target:i target_score:f rank:i", lambda s, d: _run(s, d, LAMBDA).ranked,
        "SELECT user_idx, pos, target, own AS target_score, rank FROM ranks", _scored(True),
    ),
    Query(
        "metrics_long", "group:s metric:s value:f", lambda s, d: R.metrics_long(_run(s, d).metrics, ["group"]),
        " UNION ALL ".join(f"SELECT \"group\", '{m}' AS metric, \"{m}\" AS value FROM by_group" for m in NAMES),
        (*_scored(False), f"by_group AS ({BY_GROUP})"),
    ),
    Query(
        "predictions",
        "split:s user_idx:i pos:i target_item_idx:i target_item_id:s target_rank:i history_items:l retrieved:l group:s",
        _predictions,
        "SELECT split, user_idx, pos, s.target AS target_item_idx, 'i' || s.target AS target_item_id, rank AS target_rank, "
        "['i' || x FOR x IN past] AS history_items, t.retrieved, grp AS \"group\" FROM samples s JOIN ranks USING (user_idx, pos) "
        "JOIN (SELECT user_idx, pos, list('i' || item_idx ORDER BY place) AS retrieved FROM (SELECT *, row_number() OVER "
        "(PARTITION BY user_idx, pos ORDER BY score DESC, item_idx) AS place FROM offered) WHERE place <= 10 GROUP BY user_idx, pos) t "
        "USING (user_idx, pos) JOIN grouped ON item_idx = s.target",
        _scored(False),
    ),
    Query(
        "ranking_ce", "ranking_loss:f", _ranking_loss,
        "SELECT sum((lse - own) * w) / greatest(sum(w), 1e-6) AS ranking_loss FROM (SELECT user_idx, pos, target, ln(sum(exp(x))) AS lse, "
        "max(x) FILTER (WHERE item_idx = target) AS own FROM (SELECT user_idx, pos, target, i.item_idx, "
        f"list_cosine_similarity(q.vec, i.vec) / {TAU} AS x FROM q, items i) GROUP BY user_idx, pos, target) JOIN (SELECT item_idx, "
        "least(greatest(pow(freq + 1.0, -0.5) / greatest((SELECT avg(pow(freq + 1.0, -0.5)) FROM freq WHERE freq > 0), 1e-12), 0.25), 4.0) AS w "
        "FROM freq) ON item_idx = target",
        (*QUERY_VECTORS, FREQ),
    ),
    Query(
        "retrieval_first_batches", MEASURES, _limited,
        f"SELECT {_measures()} FROM ranks JOIN samples USING (user_idx, pos) WHERE split = 'test' AND user_idx < 48", _scored(False),
    ),
]
