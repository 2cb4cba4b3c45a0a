"""Vector functions, fusion, gathering, co-occurrence, quantizers and learned vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.behaviour import CLICK_POSITIONS, SHORT, click_positions, click_samples, samples_sql
from catalog.spec import Query
from catalog.tables import CLICKS, clicks, table, vectors
from seqloom.functions import vector as V
from seqloom.operators import batches as B, collaborative as C, fusion as Fu, gather as G, quantize as Q, sampling as Sa
from seqloom.operators.cooccurrence import cooccurrence, skipgram_pairs, sppmi
from seqloom.operators.encode import hashed_text_vectors
from seqloom.operators.losses import vector_mse
from seqloom.operators.ordering import dense_index
from seqloom.sources.tables import dummy_vectors

WINDOW, DIM, PARTS = 5, 64, 4
PART_DIM = DIM // PARTS


def long_form(df: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    return df.select(*key, F.posexplode(vec).alias("dim", "value"))


LONG = (
    "elements AS MATERIALIZED (SELECT CAST(vec_id AS INTEGER) AS item_idx, unnest(range(0, len(embedding))) AS dim, "
    "CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
)
# Two aligned sources: the first and the second half of every vector.
HALVES = (
    LONG,
    "a AS (SELECT item_idx, dim, value FROM elements WHERE dim < 32)",
    "b AS (SELECT item_idx, dim - 32 AS dim, value FROM elements WHERE dim >= 32)",
    "an AS (SELECT item_idx, dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY item_idx)), 1e-12) AS value FROM a)",
    "bn AS (SELECT item_idx, dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY item_idx)), 1e-12) AS value FROM b)",
)
NORMED = "SELECT item_idx, dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY item_idx)), 1e-12) AS value FROM ({})"


def halves(spark, d) -> dict[str, DataFrame]:
    both = vectors(spark, d)
    return {
        "text": both.select("item_idx", F.slice("vec", 1, 32).alias("vec")),
        "image": both.select("item_idx", F.slice("vec", 33, 32).alias("vec")),
    }


def _fused(strategy, **kw):
    return lambda s, d: long_form(Fu.fuse(halves(s, d), strategy, **kw), ["item_idx"])


def _scrubbed(spark, d):
    """Vectors with the elements above a bound replaced by NaN, infinity or null."""
    broken = F.transform(
        "vec",
        lambda x, i: F.when((x > 0.2) & (i % 3 == 0), F.lit(float("nan")))
        .when((x > 0.2) & (i % 3 == 1), F.lit(float("-inf")))
        .when(x > 0.2, F.lit(None))
        .otherwise(x.cast("double")),
    )
    rows = vectors(spark, d).select("item_idx", broken.alias("vec"))
    return rows.select("item_idx", V.count_non_finite("vec").alias("bad"), V.scrub_non_finite("vec").alias("vec"))


def label_codebook(spark, d) -> DataFrame:
    """Mean vector per label, cut into subspaces: a codebook without fitting."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = rows.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pieces = means.groupBy((F.col("dim") / PART_DIM).cast("int").alias("subspace"), F.col("label").alias("centroid_id")).agg(
        F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v")
    )
    return pieces.select("subspace", "centroid_id", F.col("v.x").alias("vec"))


CODEBOOK = (
    LONG,
    "book AS MATERIALIZED (SELECT e.dim // 16 AS subspace, label AS centroid_id, e.dim % 16 AS d, avg(value) AS c "
    "FROM elements e JOIN embeddings ON vec_id = item_idx GROUP BY 1, 2, 3)",
)
ENCODED = (
    *CODEBOOK,
    "dists AS (SELECT item_idx, subspace, centroid_id, sum((value - c) * (value - c)) AS dist FROM elements e "
    "JOIN book ON subspace = e.dim // 16 AND d = e.dim % 16 GROUP BY ALL)",
    "assigned AS MATERIALIZED (SELECT item_idx, subspace, arg_min(centroid_id, (round(dist, 10), centroid_id)) AS centroid_id, "
    "min(dist) AS dist FROM dists GROUP BY ALL)",
    "codes AS MATERIALIZED (SELECT item_idx, list(centroid_id ORDER BY subspace) AS code FROM assigned GROUP BY item_idx)",
    "decoded AS (SELECT item_idx, subspace * 16 + d AS dim, c AS value FROM assigned JOIN book USING (subspace, centroid_id))",
)


def codes(spark, d) -> DataFrame:
    return Q.encode_product(vectors(spark, d), label_codebook(spark, d)).select(
        "item_idx", F.concat(F.lit("i"), "item_idx").alias("item_id"), "code"
    )


def _centroid_query(spark, d):
    whole = label_codebook(spark, d).groupBy("centroid_id").agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("subspace", "vec")))["vec"]).alias("vec")
    )
    return Q.assign_clusters(vectors(spark, d), whole)


CENTROIDS = (
    *CODEBOOK,
    "whole AS (SELECT item_idx, centroid_id, sum((value - c) * (value - c)) AS dist FROM elements e JOIN book "
    "ON subspace = e.dim // 16 AND d = e.dim % 16 GROUP BY ALL)",
    "nearest AS (SELECT item_idx, arg_min(centroid_id, (round(dist, 10), centroid_id)) AS centroid_id, min(dist) AS distance "
    "FROM whole GROUP BY item_idx)",
)

STEPS = (
    *CLICK_POSITIONS,
    samples_sql(SHORT),
    LONG,
    "steps AS (SELECT split, user_idx, pos, target, unnest(past) AS item_idx FROM samples)",
    "pooled AS MATERIALIZED (SELECT split, user_idx, pos, target, dim, avg(value) AS value FROM steps JOIN elements USING (item_idx) GROUP BY ALL)",
)


def _branches(spark, d):
    """Text, image and behaviour vectors of a batch: three views of the given ones; sums that tell slots apart."""
    items = vectors(spark, d)
    views = {"text": F.col("vec"), "image": F.reverse("vec"), "cf": F.slice("vec", 1, 16)}
    tables = {name: items.select("item_idx", view.alias("vec")) for name, view in views.items()}
    out = B.attach_branches(
        click_samples(spark, d, 4), tables, ["user_idx", "pos"], tables["cf"], history="history", mask="mask", target="target"
    )
    rows = []
    for name in tables:
        steps = F.transform(f"history_{name}_embeds", lambda v, i: v[0].cast("double") * (i + 1))
        target, pooled = F.col(f"target_{name}_embed"), F.col(f"pooled_{name}_embed")
        rows.append(F.struct(F.lit(name).alias("branch"), *[
            F.round(c.cast("double"), 4).alias(n)
            for n, c in {
                "slots": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x),
                "first": target[0], "last": F.element_at(target, -1),
                "pooled_first": pooled[0], "pooled_last": F.element_at(pooled, -1),
                "latent": F.element_at("target_item_latent", -1),
            }.items()
        ]))
    return out.select("user_idx", "pos", F.inline(F.array(*rows)))


BRANCH_SQL = (
    "SELECT s.user_idx, s.pos, t.branch, round(coalesce(w, 0), 4) AS slots, round(t.f, 4) AS first, round(t.l, 4) AS last, "
    "round(coalesce(pf, 0), 4) AS pooled_first, round(coalesce(pl, 0), 4) AS pooled_last, round(c.l, 4) AS latent "
    "FROM samples s JOIN views t ON t.item_idx = s.target JOIN views c ON c.item_idx = s.target AND c.branch = 'cf' "
    "LEFT JOIN (SELECT user_idx, pos, branch, sum((slot + 1) * f) AS w, avg(f) AS pf, avg(l) AS pl FROM "
    "(SELECT user_idx, pos, unnest(history) AS item_idx, unnest(range(0, 4)) AS slot FROM samples) JOIN views USING (item_idx) "
    "GROUP BY ALL) p ON p.user_idx = s.user_idx AND p.pos = s.pos AND p.branch = t.branch"
)
# Branch, and the first and last element of its vectors.
VIEWS = (
    "views AS MATERIALIZED (SELECT vec_id AS item_idx, unnest(['text', 'image', 'cf']) AS branch, "
    "CAST(unnest([embedding[1], embedding[64], embedding[1]]) AS DOUBLE) AS f, "
    "CAST(unnest([embedding[64], embedding[1], embedding[16]]) AS DOUBLE) AS l FROM embeddings)"
)


def _history_vectors(spark, d):
    out = G.gather_history(click_samples(spark, d, 4), vectors(spark, d), ["user_idx", "pos"])
    flat = out.select("user_idx", "pos", F.posexplode("history_vecs").alias("slot", "v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return flat.select("user_idx", "pos", "slot", F.size("v").alias("dim"), total.alias("total"))


PAIRS = (
    *CLICK_POSITIONS,
    "pairs AS MATERIALIZED (SELECT a.item_idx AS i, b.item_idx AS j, abs(a.pos - b.pos) AS dist FROM positions a JOIN positions b "
    f"ON a.user_idx = b.user_idx AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {WINDOW})",
    "cells AS MATERIALIZED (SELECT i, j, sum(1.0 / dist) AS w FROM pairs GROUP BY i, j)",
    "margin AS (SELECT i, sum(w) AS r FROM cells GROUP BY i)",
)


def _lengths(found: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return found.select("item_idx", F.size("vec").alias("dims"), length.alias("length"))


def _skipgram(spark, d):
    pairs = skipgram_pairs(click_positions(spark, d), WINDOW)
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def catalogue(spark, d):
    return vectors(spark, d).select("item_idx")


def _weights(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_idx"), (F.col("label") + 0.5).alias("weight")
    )


def _draws(spark, d):
    """One weighted draw per event."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("draw_id"))
    return Sa.draw_by_weight(rows, _weights(spark, d), 7)


def _negatives(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item_idx"))
    rows = events.select(F.col("event_id").alias("row_id"), F.col("user_id").cast("int").alias("user_idx"))
    owned = events.select(F.col("user_id").cast("int").alias("user_idx"), "item_idx").distinct()
    n_items = table(spark, d, "embeddings").count()
    return Sa.uniform_negatives(rows, owned, n_items, 11)


def _noise_negatives(spark, d):
    pairs = table(spark, d, "events").select(F.col("event_id").alias("pair_id"))
    noise = _weights(spark, d).withColumnRenamed("weight", "prob")
    return Sa.noise_negatives(pairs, noise, 3, 5)


def _quantized(method):
    def run(s, d):
        out = Q.quantize(vectors(s, d), method, codebook_size=8, branching=3, levels=3, iterations=3)
        return out.codes.join(out.reconstructed, "item_idx").select(
            "item_idx", "code", F.size("vec").alias("dim"), F.lit(out.mse).alias("mse")
        )

    return run


def _doc_texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("item_idx"), "text")


EMBED = "item_idx:i dim:i value:f"

QUERIES = [
    Query(
        "l2_normalize", EMBED,
        lambda s, d: long_form(halves(s, d)["text"].select("item_idx", V.l2_normalize("vec").alias("vec")), ["item_idx"]),
        "SELECT * FROM an", HALVES,
    ),
    Query(
        "pad_dim", EMBED,
        lambda s, d: long_form(Fu.reduce_dim(halves(s, d)["text"], 48), ["item_idx"]),
        "SELECT * FROM an UNION ALL SELECT item_idx, dim, 0.0 FROM (SELECT DISTINCT item_idx FROM a), (SELECT unnest(range(32, 48)) AS dim)",
        HALVES,
    ),
    Query(
        "nonfinite_scrub", "item_idx:i bad:i dim:i value:f",
        lambda s, d: long_form(_scrubbed(s, d), ["item_idx", "bad"]),
        "SELECT item_idx, count(*) FILTER (WHERE value > CAST(0.2 AS DOUBLE)) OVER (PARTITION BY item_idx) AS bad, dim, "
        "CASE WHEN value > CAST(0.2 AS DOUBLE) THEN 0.0 ELSE value END AS value FROM elements",
        (LONG,),
    ),
    Query(
        "fusion_weighted", EMBED, _fused("weighted_sum", weights={"text": 2.0, "image": 1.0}),
        NORMED.format("SELECT item_idx, dim, (2.0 * an.value + bn.value) / 3.0 AS value FROM an JOIN bn USING (item_idx, dim)"),
        HALVES,
    ),
    Query(
        "fusion_mean", EMBED, _fused("mean"),
        NORMED.format("SELECT item_idx, dim, (an.value + bn.value) / 2.0 AS value FROM an JOIN bn USING (item_idx, dim)"),
        HALVES,
    ),
    Query(
        "fusion_concat", EMBED, _fused("concat", normalize_output=True),
        NORMED.format("SELECT * FROM an UNION ALL SELECT item_idx, dim + 32, value FROM bn"),
        HALVES,
    ),
    Query(
        "source_mse", "mse:f",
        lambda s, d: (lambda h: vector_mse(h["text"].join(h["image"].withColumnRenamed("vec", "other"), "item_idx"), "vec", "other"))(halves(s, d)),
        "SELECT avg((a.value - b.value) * (a.value - b.value)) AS mse FROM a JOIN b USING (item_idx, dim)",
        HALVES,
    ),
    Query(
        "history_pool", "user_idx:i pos:i dim:i value:f",
        lambda s, d: long_form(G.pool_history(click_samples(s, d), vectors(s, d), ["user_idx", "pos"]), ["user_idx", "pos"], "pooled"),
        "SELECT * FROM pooled", STEPS,
    ),
    Query(
        "history_gather", "user_idx:i pos:i slot:i dim:i total:f", _history_vectors,
        "SELECT user_idx, pos, slot, 64 AS dim, coalesce(t, 0.0) AS total FROM (SELECT user_idx, pos, unnest(history) AS item, "
        "unnest(range(0, 4)) AS slot FROM samples) LEFT JOIN (SELECT item_idx, sum(value) AS t FROM elements GROUP BY item_idx) ON item = item_idx",
        (*CLICK_POSITIONS, samples_sql(4), LONG),
    ),
    Query(
        "branch_batches", "user_idx:i pos:i branch:s slots:f first:f last:f pooled_first:f pooled_last:f latent:f", _branches,
        BRANCH_SQL,
        (*CLICK_POSITIONS, samples_sql(4), VIEWS),
    ),
    Query(
        "target_gather", "user_idx:i pos:i dim:i value:f",
        lambda s, d: long_form(G.gather_target(click_samples(s, d), vectors(s, d), normalize=True), ["user_idx", "pos"], "target_vec"),
        "SELECT user_idx, pos, dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY user_idx, pos)), 1e-12) AS value "
        "FROM samples JOIN elements ON target = item_idx",
        (*CLICK_POSITIONS, samples_sql(SHORT), LONG),
    ),
    Query(
        "masked_mean", "label:i dim:i value:f",
        lambda s, d: long_form(
            G.masked_mean(
                table(s, d, "embeddings").select("label", F.col("embedding").alias("vec"), (F.col("vec_id") % 3 > 0).cast("int").alias("mask")),
                ["label"],
            ),
            ["label"], "pooled",
        ),
        "SELECT label, dim, sum(CASE WHEN vec_id % 3 > 0 THEN value ELSE 0 END) / greatest(count(*) FILTER (WHERE vec_id % 3 > 0), 1) "
        "AS value FROM elements JOIN embeddings ON vec_id = item_idx GROUP BY label, dim",
        (LONG,),
    ),
    Query(
        "cooccurrence", "item_i:i item_j:i weight:f",
        lambda s, d: cooccurrence(click_positions(s, d), WINDOW),
        "SELECT i AS item_i, j AS item_j, w AS weight FROM cells", PAIRS,
    ),
    Query(
        "sppmi", "item_i:i item_j:i sppmi:f",
        lambda s, d: sppmi(cooccurrence(click_positions(s, d), WINDOW), 1.5, keep_zeros=True),
        "SELECT c.i AS item_i, c.j AS item_j, greatest(ln(w * (SELECT sum(r) FROM margin) / (a.r * b.r)) - ln(1.5), 0) AS sppmi "
        "FROM cells c JOIN margin a ON a.i = c.i JOIN margin b ON b.i = c.j",
        PAIRS,
    ),
    Query(
        "skipgram_pairs", "center:i context:i n:i", _skipgram,
        "SELECT i AS center, j AS context, count(*) AS n FROM pairs GROUP BY i, j", PAIRS,
    ),
    Query(
        "nearest_centroid", "item_idx:i centroid_id:i distance:f", _centroid_query, "SELECT * FROM nearest", CENTROIDS,
    ),
    Query(
        "kmeans_inertia", "inertia:f", lambda s, d: Q.inertia(_centroid_query(s, d)),
        "SELECT sum(distance) AS inertia FROM nearest", CENTROIDS,
    ),
    Query("pq_encode", "item_idx:i code:l", codes, "SELECT * FROM codes", ENCODED),
    Query(
        "pq_decode", EMBED,
        lambda s, d: long_form(Q.decode_product(codes(s, d), label_codebook(s, d)), ["item_idx"]),
        "SELECT * FROM decoded", ENCODED,
    ),
    Query(
        "pq_mse", "mse:f",
        lambda s, d: Q.reconstruction_mse(vectors(s, d), Q.decode_product(codes(s, d), label_codebook(s, d))),
        "SELECT avg((e.value - p.value) * (e.value - p.value)) AS mse FROM elements e JOIN decoded p USING (item_idx, dim)",
        ENCODED,
    ),
    Query("quantize_pq", "item_idx:i code:l dim:i mse:f", _quantized("pq")),
    Query("quantize_opq", "item_idx:i code:l dim:i mse:f", _quantized("opq")),
    Query("quantize_rkmeans", "item_idx:i code:l dim:i mse:f", _quantized("rkmeans")),
    Query("pca_reduce", EMBED, lambda s, d: long_form(Fu.reduce_dim(vectors(s, d), 16), ["item_idx"])),
    Query("dummy_vectors", EMBED, lambda s, d: long_form(dummy_vectors(catalogue(s, d), 16, 3), ["item_idx"])),
    Query(
        "sppmi_vectors", EMBED,
        lambda s, d: long_form(C.sppmi_vectors(click_positions(s, d), catalogue(s, d), 16), ["item_idx"]),
    ),
    # Trained factors differ from engine to engine; what must hold of them is told item by item.
    Query(
        "item2vec", "item_idx:i dims:i length:f",
        lambda s, d: _lengths(C.item2vec_vectors(click_positions(s, d), catalogue(s, d))),
        "SELECT vec_id AS item_idx, 128 AS dims, 1.0 AS length FROM embeddings",
    ),
    Query("als_mf", EMBED, lambda s, d: long_form(C.als_vectors(clicks(s, d), catalogue(s, d), 16, 3), ["item_idx"])),
    Query(
        "bpr_mf", "item_idx:i dims:i length:f", lambda s, d: _lengths(C.bpr_vectors(clicks(s, d), catalogue(s, d))),
        "SELECT vec_id AS item_idx, 128 AS dims, 1.0 AS length FROM embeddings",
    ),
    Query("hashed_text_vectors", EMBED, lambda s, d: long_form(hashed_text_vectors(_doc_texts(s, d), 64), ["item_idx"])),
    Query("weighted_sample", "draw_id:i item_idx:i", _draws),
    Query("noise_negatives", "pair_id:i negative_no:i negative:i", _noise_negatives),
    Query("uniform_negatives", "row_id:i user_idx:i negative:i", _negatives),
    Query(
        "epoch_order", "event_id:i",
        lambda s, d: Sa.epoch_order(table(s, d, "events").select("event_id"), ["event_id"], 1, 2),
        "SELECT event_id FROM events",
    ),
]
