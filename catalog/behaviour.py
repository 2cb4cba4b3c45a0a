"""Interactions, k-core, ids, sequences, samples, popularity and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.spec import Query
from catalog.tables import CLICKS, PURCHASES, clicks, purchases, table
from seqloom.operators import popularity as P, samples as S
from seqloom.operators.kcore import k_core
from seqloom.operators.ordering import dense_index
from seqloom.operators.sequences import build_samples, number_positions, sequence_arrays
from seqloom.plans.prepare import prepare
from seqloom.sources import records as R

ROUNDS = 12  # unrolled rounds of the SQL twin; ten suffice at every given scale
SHORT, LONG, CHUNK = 10, 50, 1000


def core_sql(k: int, rounds: int = ROUNDS) -> tuple[str, ...]:
    steps = [PURCHASES, "core0 AS MATERIALIZED (SELECT * FROM purchases)"]
    for i in range(1, rounds + 1):
        p = f"core{i - 1}"
        steps.append(
            f"core{i} AS MATERIALIZED (SELECT * FROM {p} "
            f"WHERE user_id IN (SELECT user_id FROM {p} GROUP BY user_id HAVING count(*) >= {k}) "
            f"AND item_id IN (SELECT item_id FROM {p} GROUP BY item_id HAVING count(*) >= {k}))"
        )
    return tuple(steps)


def indexed_sql(k: int) -> tuple[str, ...]:
    return (
        *core_sql(k),
        "user_map AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx "
        f"FROM (SELECT DISTINCT user_id FROM core{ROUNDS}))",
        "item_map AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx "
        f"FROM (SELECT DISTINCT item_id FROM core{ROUNDS}))",
        "positions AS MATERIALIZED (SELECT user_idx, item_idx, ts, "
        "row_number() OVER (PARTITION BY user_idx ORDER BY ts, item_idx) - 1 AS pos, "
        "count(*) OVER (PARTITION BY user_idx) AS seq_len "
        f"FROM core{ROUNDS} JOIN user_map USING (user_id) JOIN item_map USING (item_id))",
    )


CLICK_POSITIONS = (
    CLICKS,
    "positions AS MATERIALIZED (SELECT user_idx, item_idx, ts, "
    "row_number() OVER (PARTITION BY user_idx ORDER BY ts, item_idx) - 1 AS pos, "
    "count(*) OVER (PARTITION BY user_idx) AS seq_len FROM clicks)",
)


def samples_sql(h: int) -> str:
    return (
        "samples AS MATERIALIZED (SELECT CASE WHEN pos = seq_len - 1 THEN 'test' "
        "WHEN pos = seq_len - 2 THEN 'val' ELSE 'train' END AS split, user_idx, pos, past, "
        f"list_concat([-1 FOR _ IN range(0, {h} - len(past))], past) AS history, "
        f"list_concat([false FOR _ IN range(0, {h} - len(past))], [true FOR _ IN past]) AS mask, target "
        "FROM (SELECT user_idx, pos, seq_len, item_idx AS target, list(item_idx) OVER "
        "(PARTITION BY user_idx ORDER BY ts, item_idx "
        f"ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING) AS past FROM positions) WHERE pos >= 1)"
    )


SIZES = "sizes AS (SELECT user_idx, count(*) AS seq_len FROM positions GROUP BY user_idx)"
COUNTS = (
    "counts AS (SELECT 'train' AS split, sum(greatest(seq_len - 3, 0)) AS raw_count FROM sizes "
    "UNION ALL SELECT 'val', sum(CASE WHEN seq_len >= 3 THEN 1 ELSE 0 END) FROM sizes "
    "UNION ALL SELECT 'test', sum(CASE WHEN seq_len >= 2 THEN 1 ELSE 0 END) FROM sizes)"
)
PLAN = (
    f"plan AS (SELECT split, raw_count, raw_count // {CHUNK} AS full_chunks, "
    f"raw_count AS samples_to_write, (raw_count + {CHUNK - 1}) // {CHUNK} AS chunks, 0 AS dropped_tail FROM counts)"
)
FREQ = (
    "freq AS (SELECT item_idx, count(target) AS freq FROM item_map LEFT JOIN "
    "(SELECT target FROM samples WHERE split = 'train') ON target = item_idx GROUP BY item_idx)"
)


def prepared(spark, d):
    return prepare(purchases(spark, d), 5)


def click_positions(spark, d):
    return number_positions(clicks(spark, d))


def click_samples(spark, d, h: int = SHORT):
    return build_samples(click_positions(spark, d), h)


def frequency(spark, d):
    p = prepared(spark, d)
    return P.target_frequency(p.samples(SHORT).filter("split = 'train'"), p.item_map)


def _review_lines(spark, d):
    """Purchases as review lines: JSON, some as Python literals, some broken or blank."""
    rows = purchases(spark, d).withColumn("kind", F.col("item_id").cast("int") % 4)
    as_json = F.to_json(
        F.struct(
            F.concat(F.lit("  u\t"), "user_id").alias("reviewerID"),
            F.array("item_id", F.lit("")).alias("asin"),
            F.col("ts").cast("string").alias("unixReviewTime"),
        )
    )
    literal = F.format_string(
        "{'reviewerID': 'u %s', 'asin': '%s', 'unixReviewTime': %d.75, 'verified': True, 'vote': None}",
        "user_id", "item_id", "ts",
    )
    value = (
        F.when(F.col("kind") == 0, literal).when(F.col("kind") == 1, "[1, 2]").when(F.col("kind") == 2, "{broken")
        .otherwise(as_json)
    )
    return rows.select(value.alias("value"), F.lit(0).alias("line_order"))


def _core_frame(k):
    return lambda spark, d: k_core(purchases(spark, d), k).interactions


def _trace_sql(k: int) -> str:
    parts = [
        f"SELECT {i + 1} AS iteration, (SELECT count(*) FROM core{i}) AS rows_before, "
        f"(SELECT count(*) FROM core{i + 1}) AS rows_after, "
        f"(SELECT count(DISTINCT user_id) FROM core{i}) AS n_users, "
        f"(SELECT count(DISTINCT item_id) FROM core{i}) AS n_items"
        for i in range(ROUNDS)
    ]
    union = " UNION ALL ".join(parts)
    return (
        f"SELECT * FROM ({union}) AS t WHERE iteration <= (SELECT min(iteration) FROM ({union}) AS u "
        "WHERE rows_before = rows_after)"
    )


def _trace(k):
    return lambda spark, d: k_core(purchases(spark, d), k).trace_frame(spark)


def _chunk_query(spark, d):
    return prepared(spark, d).chunks(SHORT, CHUNK)


QUERIES = [
    Query("interactions", "user_id:s item_id:s ts:i", purchases, "SELECT * FROM purchases", (PURCHASES,)),
    Query(
        "rejected_lines",
        "reason:s n:i",
        lambda s, d: R.split_records(_review_lines(s, d)).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE CAST(item_id AS INTEGER) % 4 WHEN 1 THEN 'not a record' ELSE 'neither JSON nor a literal' END AS reason, count(*) AS n "
        "FROM purchases WHERE CAST(item_id AS INTEGER) % 4 IN (1, 2) GROUP BY 1",
        (PURCHASES,),
    ),
    Query(
        "raw_reviews",
        "user_id:s item_id:s ts:i",
        lambda s, d: R.review_interactions(R.parse_records(_review_lines(s, d))),
        "SELECT 'u ' || user_id AS user_id, item_id, ts FROM purchases WHERE CAST(item_id AS BIGINT) % 4 IN (0, 3)",
        (PURCHASES,),
    ),
    Query("kcore_5", "user_id:s item_id:s ts:i", _core_frame(5), f"SELECT * FROM core{ROUNDS}", core_sql(5)),
    Query("kcore_22", "user_id:s item_id:s ts:i", _core_frame(22), f"SELECT * FROM core{ROUNDS}", core_sql(22)),
    Query(
        "kcore_trace", "iteration:i rows_before:i rows_after:i n_users:i n_items:i", _trace(22), _trace_sql(22), core_sql(22)
    ),
    Query(
        "dense_ids_user",
        "user_id:s user_idx:i",
        lambda s, d: dense_index(purchases(s, d), "user_id", "user_idx"),
        "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM purchases)",
        (PURCHASES,),
    ),
    Query(
        "dense_ids_item",
        "item_id:s item_idx:i",
        lambda s, d: dense_index(purchases(s, d), "item_id", "item_idx"),
        "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM purchases)",
        (PURCHASES,),
    ),
    Query(
        "user_positions",
        "user_idx:i item_idx:i ts:i pos:i seq_len:i",
        lambda s, d: prepared(s, d).positions,
        "SELECT * FROM positions",
        indexed_sql(5),
    ),
    Query(
        "user_sequences",
        "user_idx:i block:i items:l",
        lambda s, d: sequence_arrays(prepared(s, d).positions, block_rows=64),
        "SELECT user_idx, pos // 64 AS block, list(item_idx ORDER BY pos) AS items FROM positions GROUP BY user_idx, pos // 64",
        indexed_sql(5),
    ),
    Query(
        "split_samples",
        "split:s user_idx:i pos:i history:l mask:l target:i",
        lambda s, d: prepared(s, d).samples(LONG),
        "SELECT * FROM samples",
        (*indexed_sql(5), samples_sql(LONG)),
    ),
    Query(
        "history_item_ids",
        "user_idx:i pos:i history_items:l",
        lambda s, d: prepared(s, d).history_names(SHORT),
        "SELECT user_idx, s.pos, list(item_id ORDER BY n) AS history_items FROM (SELECT user_idx, pos, unnest(past) AS item_idx, "
        "unnest(range(0, len(past))) AS n FROM samples) s JOIN item_map USING (item_idx) GROUP BY user_idx, s.pos",
        (*indexed_sql(5), samples_sql(SHORT)),
    ),
    Query(
        "unsplit_samples",
        "split:s user_idx:i pos:i target:i",
        lambda s, d: prepared(s, d).samples(SHORT, "none"),
        "SELECT 'train' AS split, user_idx, pos, target FROM samples",
        (*indexed_sql(5), samples_sql(SHORT)),
    ),
    Query(
        "split_counts",
        "split:s raw_count:i",
        lambda s, d: S.split_counts(prepared(s, d).sizes),
        "SELECT * FROM counts",
        (*indexed_sql(5), SIZES, COUNTS),
    ),
    Query(
        "write_plan",
        "split:s raw_count:i samples_to_write:i full_chunks:i chunks:i dropped_tail:i",
        lambda s, d: S.write_plan(S.split_counts(prepared(s, d).sizes), CHUNK),
        "SELECT * FROM plan",
        (*indexed_sql(5), SIZES, COUNTS, PLAN),
    ),
    Query(
        "chunk_assign",
        "split:s user_idx:i pos:i chunk_id:i slot:i target:i",
        _chunk_query,
        "SELECT split, user_idx, pos, n // 1000 AS chunk_id, n % 1000 AS slot, target FROM (SELECT *, "
        "row_number() OVER (PARTITION BY split ORDER BY user_idx, pos) - 1 AS n FROM samples) JOIN plan USING (split) "
        "WHERE n < samples_to_write",
        (*indexed_sql(5), samples_sql(SHORT), SIZES, COUNTS, PLAN),
    ),
    Query(
        "dataset_stats",
        "history_len:i chunk_size:i k_core:i split_mode:s num_users:i num_items:i total_samples:i samples_written:i "
        "dropped_tail:i chunks_written:i approx_bytes:i",
        lambda s, d: (lambda p: S.dataset_stats(p.sizes, p.item_map, LONG, CHUNK))(prepared(s, d)),
        f"SELECT {LONG} AS history_len, {CHUNK} AS chunk_size, 5 AS k_core, 'leave_last_two' AS split_mode, "
        "(SELECT count(*) FROM sizes) AS num_users, (SELECT count(*) FROM item_map) AS num_items, "
        "sum(raw_count) AS total_samples, sum(samples_to_write) AS samples_written, sum(dropped_tail) AS dropped_tail, "
        f"sum(chunks) AS chunks_written, sum(samples_to_write) * {LONG * 5 + 8} AS approx_bytes FROM plan",
        (*indexed_sql(5), SIZES, COUNTS, PLAN),
    ),
    Query(
        "item_frequency",
        "item_idx:i freq:i",
        frequency,
        "SELECT * FROM freq",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "popularity_equal",
        "item_idx:i freq:i group_id:i group:s",
        lambda s, d: P.popularity_groups(frequency(s, d), "equal_items"),
        "SELECT item_idx, freq, g AS group_id, ['cold', 'mid', 'hot'][g + 1] AS \"group\" FROM "
        "(SELECT *, ntile(3) OVER (ORDER BY freq, item_idx) - 1 AS g FROM freq)",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "popularity_quantile",
        "item_idx:i freq:i group_id:i group:s",
        lambda s, d: P.popularity_groups(frequency(s, d), "quantile_frequency"),
        "SELECT item_idx, freq, g AS group_id, ['cold', 'mid', 'hot'][g + 1] AS \"group\" FROM (SELECT item_idx, freq, "
        "CASE WHEN freq > q2 THEN 2 WHEN freq > q1 THEN 1 ELSE 0 END AS g FROM freq, (SELECT "
        "quantile_cont(CAST(freq AS DOUBLE), 1.0/3.0) AS q1, quantile_cont(CAST(freq AS DOUBLE), 2.0/3.0) AS q2 FROM freq))",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "frequency_quantiles",
        "q33:f q66:f",
        lambda s, d: P.frequency_quantiles(frequency(s, d)),
        "SELECT quantile_cont(CAST(freq AS DOUBLE), 1.0/3.0) AS q33, quantile_cont(CAST(freq AS DOUBLE), 2.0/3.0) AS q66 FROM freq",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "popularity_summary",
        "group_id:i group:s num_items:i min_frequency:i max_frequency:i mean_frequency:f",
        lambda s, d: P.group_summary(P.popularity_groups(frequency(s, d))),
        "SELECT g AS group_id, ['cold', 'mid', 'hot'][g + 1] AS \"group\", count(*) AS num_items, min(freq) AS min_frequency, "
        "max(freq) AS max_frequency, avg(freq) AS mean_frequency FROM "
        "(SELECT *, ntile(3) OVER (ORDER BY freq, item_idx) - 1 AS g FROM freq) GROUP BY g",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "popularity_penalty",
        "item_idx:i penalty:f",
        lambda s, d: P.popularity_penalty(frequency(s, d)),
        "SELECT item_idx, coalesce(ln(1 + freq) / nullif((SELECT max(ln(1 + freq)) FROM freq), 0), 0) AS penalty FROM freq",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "inverse_freq_weights",
        "item_idx:i weight:f",
        lambda s, d: P.inverse_frequency_weights(frequency(s, d)),
        "SELECT item_idx, least(greatest(pow(freq + 1.0, -0.5) / greatest((SELECT avg(pow(freq + 1.0, -0.5)) FROM freq "
        "WHERE freq > 0), 1e-12), 0.25), 4.0) AS weight FROM freq",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "weight_summary",
        "min_weight:f mean_weight:f max_weight:f",
        lambda s, d: P.weight_summary(P.inverse_frequency_weights(frequency(s, d))),
        "SELECT min(w) AS min_weight, avg(w) AS mean_weight, max(w) AS max_weight FROM (SELECT least(greatest("
        "pow(freq + 1.0, -0.5) / greatest((SELECT avg(pow(freq + 1.0, -0.5)) FROM freq WHERE freq > 0), 1e-12), 0.25), 4.0) "
        "AS w FROM freq)",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "noise_distribution",
        "item_idx:i prob:f",
        lambda s, d: P.noise_distribution(frequency(s, d)),
        "SELECT item_idx, pow(greatest(freq, 1), 0.75) / (SELECT sum(pow(greatest(freq, 1), 0.75)) FROM freq) AS prob FROM freq",
        (*indexed_sql(5), samples_sql(SHORT), FREQ),
    ),
    Query(
        "user_positives",
        "user_idx:i item_idx:i",
        lambda s, d: clicks(s, d).select("user_idx", "item_idx").distinct(),
        "SELECT DISTINCT user_idx, item_idx FROM clicks",
        (CLICKS,),
    ),
]
