"""Semantic codes: layout, tokenized samples, prefixes, decoding, code scores and losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalog.behaviour import CLICK_POSITIONS, SHORT, click_samples, samples_sql
from catalog.spec import Query
from catalog.tables import vectors
from catalog.vectors import ENCODED, PARTS, STEPS, codes, label_codebook
from seqloom.operators import codes as K, losses as Lo
from seqloom.operators.gather import as_lists, as_matrix, pool_history
from seqloom.operators.retrieval import rank_catalogue
from seqloom.plans.evaluate import code_items, code_queries
from seqloom.session import materialize, spread

KEY = ["user_idx", "pos"]
WIDTH = 2 + PARTS + SHORT * (PARTS + 1)  # token places of a sample

LAYOUT = (
    "layout AS MATERIALIZED (SELECT pos, size, 5 + coalesce(sum(size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS off FROM (SELECT pos, max(v) + 1 AS size FROM (SELECT unnest(range(0, 4)) AS pos, "
    "unnest(code) AS v FROM codes) GROUP BY pos))"
)
TOKENS = (
    *ENCODED,
    LAYOUT,
    "item_tokens AS MATERIALIZED (SELECT item_idx, code, list(v + off ORDER BY pos) AS tok FROM (SELECT item_idx, code, "
    "unnest(range(0, 4)) AS pos, unnest(code) AS v FROM codes) JOIN layout USING (pos) GROUP BY item_idx, code)",
)
TOKENIZED = (
    *TOKENS,
    *CLICK_POSITIONS,
    samples_sql(SHORT),
    f"steps AS (SELECT user_idx, pos, unnest(past) AS item_idx, unnest(range({SHORT} - len(past), {SHORT})) AS slot FROM samples)",
    "hist AS (SELECT user_idx, pos, count(*) AS n, flatten(list(list_append(tok, 3) ORDER BY slot)) AS toks, "
    "flatten(list([slot, slot, slot, slot, slot] ORDER BY slot)) AS slots, flatten(list([0, 1, 2, 3, -1] ORDER BY slot)) AS books, "
    "flatten(list(code ORDER BY slot)) AS hist_codes FROM steps JOIN item_tokens USING (item_idx) GROUP BY user_idx, pos)",
    "ready AS (SELECT s.*, h.*, t.tok AS goal, t.code AS goal_code, 6 + h.n * 5 AS used, "
    f"{WIDTH} - 6 - h.n * 5 AS rest FROM samples s JOIN hist h USING (user_idx, pos) JOIN item_tokens t ON t.item_idx = s.target)",
)


def layout_of(table: DataFrame) -> K.TokenLayout:
    return K.infer_layout(table)


def _stored_codes(spark, d):
    return materialize(codes(spark, d), "codes")


def tokenized(spark, d):
    table = _stored_codes(spark, d)
    return K.tokenize_samples(click_samples(spark, d), table, layout_of(table), SHORT)


def _flat_tokens(spark, d):
    return tokenized(spark, d).withColumn("history_semantic_ids", F.flatten("history_semantic_ids"))


def with_logits(spark, d, layout: K.TokenLayout, kept: tuple[str, ...] = ("split", *KEY, "history", "mask", "target", "seq_len")) -> DataFrame:
    """Samples (the columns ``kept``) with logits over the vocabulary: pooled history against every code centroid."""
    book = label_codebook(spark, d).collect()  # subspaces x labels, a fixed size
    vecs = {(r["subspace"], r["centroid_id"]): r["vec"] for r in book}
    samples = click_samples(spark, d).select(*dict.fromkeys((*kept, "history", "mask")))
    pooled = pool_history(spread(samples), vectors(spark, d), KEY).select(*kept, "pooled")
    pieces = [np.array([vecs[c, v] for v in range(size)]) for c, size in enumerate(layout.vocab_sizes)]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = as_matrix(batch.column("pooled"))
            cuts = np.split(whole, PARTS, axis=1)
            row = np.concatenate([np.zeros((len(whole), K.RESERVED_TOKENS)), *[x @ c.T for x, c in zip(cuts, pieces)]], axis=1)
            starts = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * PARTS)
            logits = pa.ListArray.from_arrays(starts, as_lists(np.repeat(row, PARTS, axis=0)))
            kept = [n for n in batch.schema.names if n != "pooled"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], logits], [*kept, "logits"])

    return pooled.mapInArrow(run, pooled.drop("pooled").withColumn("logits", F.array(F.array(F.lit(0.0)))).schema)


LOGITS = (
    *TOKENS,
    *STEPS[: len(CLICK_POSITIONS) + 1],
    *STEPS[len(CLICK_POSITIONS) + 2 :],
    "dots AS MATERIALIZED (SELECT user_idx, p.pos, target, subspace, centroid_id, sum(value * c) AS logit FROM pooled p JOIN book "
    "ON subspace = dim // 16 AND d = dim % 16 JOIN layout l ON l.pos = subspace AND centroid_id < size GROUP BY ALL)",
    "goals AS (SELECT item_idx, unnest(range(0, 4)) AS subspace, unnest(code) AS v FROM codes)",
)


def _decoded(spark, d):
    table = _stored_codes(spark, d)
    layout = layout_of(table)
    return K.greedy_decode(with_logits(spark, d, layout, tuple(KEY)), layout, materialize(K.prefix_table(table), "prefixes"))


def _decoded_freely(spark, d):
    layout = layout_of(_stored_codes(spark, d))
    return K.greedy_decode(with_logits(spark, d, layout, tuple(KEY)), layout)


def _decode_step(n: int) -> str:
    known = " AND ".join(f"k.c{i} = p.c{i}" for i in range(n)) or "true"
    chosen = ", ".join(f"p.c{i}" for i in range(n))
    prefix = f"{chosen}, " if n else ""
    before = f"step{n - 1} p" if n else "(SELECT DISTINCT user_idx, pos FROM dots) p"
    columns = ", ".join(f"code[{i + 1}] AS c{i}" for i in range(n + 1))
    return (
        f"step{n} AS MATERIALIZED (SELECT user_idx, pos, {prefix}arg_max(centroid_id, (logit, -centroid_id)) AS c{n} FROM {before} "
        f"JOIN (SELECT DISTINCT {columns} FROM codes) k ON {known} JOIN dots USING (user_idx, pos) "
        f"WHERE subspace = {n} AND centroid_id = k.c{n} GROUP BY ALL)"
    )


DECODED = (*LOGITS, *[_decode_step(n) for n in range(PARTS)])


def _lookup(spark, d):
    table = _stored_codes(spark, d)
    wanted = table.select("item_idx", F.reverse("code").alias("code"))
    return K.lookup_codes(wanted, K.code_groups(table))


def _code_ranks(spark, d):
    table = _stored_codes(spark, d)
    layout = layout_of(table)
    queries = code_queries(with_logits(spark, d, layout, (*KEY, "history", "mask", "target")))
    return rank_catalogue(queries, code_items(table, layout), KEY, k=10, score="code")


CODE_SCORES = (
    *LOGITS,
    "norms AS (SELECT user_idx, pos, ln(5.0 + sum(exp(logit))) AS norm FROM dots GROUP BY user_idx, pos)",
    "scores AS MATERIALIZED (SELECT user_idx, pos, target, item_idx, round(sum(logit) - 4 * norm, 10) AS score FROM dots "
    "JOIN goals USING (subspace) JOIN norms USING (user_idx, pos) WHERE centroid_id = v GROUP BY user_idx, pos, target, item_idx, norm)",
    "best AS (SELECT user_idx, pos, score AS own FROM scores WHERE item_idx = target)",
    "offered AS (SELECT c.* FROM scores c JOIN samples s USING (user_idx, pos) WHERE c.item_idx = c.target OR NOT list_contains(s.past, c.item_idx))",
)


def _labelled_logits(spark, d) -> tuple[DataFrame, K.TokenLayout]:
    """(user_idx, pos, logits, labels) and the layout: logits over the whole vocabulary per code position."""
    table = _stored_codes(spark, d)
    layout = layout_of(table)
    goal = table.select(F.col("item_idx").alias("target"), K.encode_code("code", layout).alias("labels"))
    return with_logits(spark, d, layout, (*KEY, "target")).join(goal, "target").select(*KEY, "logits", "labels"), layout


def _smoothed_loss(spark, d):
    return Lo.cross_entropy_arrays(_labelled_logits(spark, d)[0], "logits", "labels", 0.1, "user_idx")


def _masked_loss(spark, d):
    rows, layout = _labelled_logits(spark, d)
    ranges = [(start, start + size) for start, size in zip(layout.offsets, layout.vocab_sizes)]
    return Lo.cross_entropy_arrays(rows, "logits", "labels", ranges=ranges, blocked=K.BLOCKED_LOGIT)


def _accuracy(spark, d):
    table = _stored_codes(spark, d)
    layout = layout_of(table)
    free = K.greedy_decode(with_logits(spark, d, layout, (*KEY, "target")), layout).select(
        *KEY, "target", K.encode_code("code", layout).alias("predicted")
    )
    goal = table.select(F.col("item_idx").alias("target"), K.encode_code("code", layout).alias("labels"))
    return Lo.masked_accuracy(free.join(goal, "target"))


def _log_probs(spark, d):
    rows, layout = _labelled_logits(spark, d)
    flat = Lo.log_softmax_arrays(rows.select("logits")).select(F.posexplode("log_probs").alias("place", "log_prob"))
    size = layout.vocab_size
    means = flat.groupBy("place").agg(F.avg("log_prob").alias("log_prob"))
    return means.select(F.expr(f"place div {size}").alias("codebook"), (F.col("place") % size).alias("token"), "log_prob")


REPEAT = "[{} FOR _ IN range(0, {})]"

QUERIES = [
    Query(
        "code_collisions", "code_key:s items:l n_items:i", lambda s, d: K.code_groups(_stored_codes(s, d)),
        "SELECT array_to_string(code, '-') AS code_key, list('i' || item_idx ORDER BY item_idx) AS items, count(*) AS n_items FROM codes GROUP BY code",
        ENCODED,
    ),
    Query(
        "vocab_sizes", "pos:i vocab_size:i token_offset:i", lambda s, d: K.vocab_sizes(_stored_codes(s, d)),
        "SELECT pos, size AS vocab_size, off AS token_offset FROM layout", (*ENCODED, LAYOUT),
    ),
    Query(
        "candidate_tokens", "item_idx:i codebook:i token:i",
        lambda s, d: (lambda t: K.candidate_tokens(t, layout_of(t)))(_stored_codes(s, d)),
        "SELECT item_idx, unnest(range(0, 4)) AS codebook, unnest(tok) AS token FROM item_tokens", TOKENS,
    ),
    Query(
        "tokenize_samples",
        "split:s user_idx:i pos:i input_ids:l attention_mask:l labels:l token_slot_ids:l token_codebook_ids:l seq_lengths:i "
        "history_item_ids:l history_mask:l target_item_ids:i history_semantic_ids:l target_semantic_ids:l",
        _flat_tokens,
        "SELECT split, user_idx, pos, list_concat(list_concat([2], toks), list_concat([1, 1, 1, 1, 4], "
        f"{REPEAT.format(0, 'rest')})) AS input_ids, "
        f"list_concat({REPEAT.format('true', 'used')}, {REPEAT.format('false', 'rest')}) AS attention_mask, "
        f"list_concat(list_concat({REPEAT.format(-100, 'used - 5')}, goal), {REPEAT.format(-100, 'rest + 1')}) AS labels, "
        f"list_concat(list_concat([-1], slots), list_concat([{SHORT}, {SHORT}, {SHORT}, {SHORT}], {REPEAT.format(-1, 'rest + 1')})) AS token_slot_ids, "
        f"list_concat(list_concat([-1], books), list_concat([0, 1, 2, 3], {REPEAT.format(-1, 'rest + 1')})) AS token_codebook_ids, "
        "used AS seq_lengths, history AS history_item_ids, mask AS history_mask, target AS target_item_ids, "
        f"list_concat({REPEAT.format(-1, f'4 * ({SHORT} - n)')}, hist_codes) AS history_semantic_ids, goal_code AS target_semantic_ids FROM ready",
        TOKENIZED,
    ),
    Query(
        "target_positions", "user_idx:i pos:i target_positions:l",
        lambda s, d: K.target_positions(tokenized(s, d), PARTS),
        "SELECT user_idx, pos, [used - 5, used - 4, used - 3, used - 2] AS target_positions FROM ready", TOKENIZED,
    ),
    Query(
        "prefix_next", "prefix:l next_values:l is_code:b", lambda s, d: K.prefix_table(_stored_codes(s, d)),
        "SELECT prefix, coalesce(list(DISTINCT v ORDER BY v) FILTER (WHERE v IS NOT NULL), []) AS next_values, bool_or(n = 4) AS is_code "
        "FROM (SELECT code[1:n] AS prefix, code[n + 1] AS v, n FROM codes, (SELECT unnest(range(0, 5)) AS n)) GROUP BY prefix",
        ENCODED,
    ),
    Query(
        "code_lookup", "item_idx:i code:l items:l", _lookup,
        "SELECT w.item_idx, w.code, coalesce(items, []) AS items FROM (SELECT item_idx, list_reverse(code) AS code FROM codes) w "
        "LEFT JOIN (SELECT code, list('i' || item_idx ORDER BY item_idx) AS items FROM codes GROUP BY code) g ON g.code = w.code",
        ENCODED,
    ),
    Query(
        "constrained_decode", "user_idx:i pos:i code:l", _decoded,
        "SELECT user_idx, pos, [c0, c1, c2, c3] AS code FROM step3", DECODED,
    ),
    Query(
        "unconstrained_decode", "user_idx:i pos:i code:l", _decoded_freely,
        "SELECT user_idx, pos, list(v ORDER BY subspace) AS code FROM (SELECT user_idx, pos, subspace, "
        "arg_max(centroid_id, (logit, -centroid_id)) AS v FROM dots GROUP BY ALL) GROUP BY user_idx, pos",
        LOGITS,
    ),
    Query(
        "code_logprob_ranks", "user_idx:i pos:i target:i target_score:f rank:i", _code_ranks,
        "SELECT user_idx, pos, target, own AS target_score, count(*) FILTER (WHERE score > own) + 1 AS rank "
        "FROM offered JOIN best USING (user_idx, pos) GROUP BY ALL",
        CODE_SCORES,
    ),
    Query(
        "code_logprob_top", "user_idx:i pos:i place:i item_idx:i score:f",
        lambda s, d: _code_ranks(s, d).select(*KEY, F.posexplode("top").alias("place", "t")).select(*KEY, "place", "t.item_idx", "t.score"),
        "SELECT user_idx, pos, place, item_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY user_idx, pos "
        "ORDER BY score DESC, item_idx) - 1 AS place FROM offered) WHERE place < 10",
        CODE_SCORES,
    ),
    Query(
        "log_softmax", "codebook:i token:i log_prob:f", _log_probs,
        "SELECT codebook, token, avg(x) AS log_prob FROM (SELECT unnest(range(0, 4)) AS codebook, token, x FROM (SELECT token, logit - norm AS x "
        "FROM (SELECT user_idx, d.pos, off + centroid_id AS token, logit FROM dots d JOIN layout l ON l.pos = subspace UNION ALL "
        "SELECT user_idx, pos, t, 0.0 FROM norms, (SELECT unnest(range(0, 5)) AS t)) JOIN norms USING (user_idx, pos))) GROUP BY codebook, token",
        CODE_SCORES,
    ),
    Query(
        "masked_ce", "loss:f",
        _masked_loss,
        "SELECT avg(norm - own) AS loss FROM (SELECT user_idx, pos, subspace, ln(sum(exp(logit))) AS norm, "
        "max(logit) FILTER (WHERE centroid_id = v) AS own FROM dots JOIN goals USING (subspace) WHERE item_idx = target GROUP BY ALL)",
        LOGITS,
    ),
    Query(
        "smoothed_ce_by_batch", "loss:f",
        _smoothed_loss,
        "SELECT avg(l) AS loss FROM (SELECT user_idx, avg(0.9 * (norm - own) + 0.1 * (norm - mean)) AS l FROM (SELECT user_idx, pos, subspace, "
        "max(logit) FILTER (WHERE centroid_id = v) AS own FROM dots JOIN goals USING (subspace) WHERE item_idx = target GROUP BY ALL) "
        "JOIN (SELECT user_idx, pos, sum(logit) / (5 + count(*)) AS mean, ln(5.0 + sum(exp(logit))) AS norm FROM dots GROUP BY user_idx, pos) "
        "USING (user_idx, pos) GROUP BY user_idx)",
        LOGITS,
    ),
    Query(
        "masked_accuracy", "correct:i total:i accuracy:f", _accuracy,
        "SELECT count(*) FILTER (WHERE p.v = g.v) AS correct, count(*) AS total, count(*) FILTER (WHERE p.v = g.v) / count(*) AS accuracy FROM "
        "(SELECT user_idx, pos, target, subspace, arg_max(centroid_id, (logit, -centroid_id)) AS v FROM dots GROUP BY ALL) p "
        "JOIN goals g ON g.item_idx = p.target AND g.subspace = p.subspace",
        LOGITS,
    ),
]
