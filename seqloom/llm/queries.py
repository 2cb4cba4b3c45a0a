"""The numbered operators as queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import decontaminate, exact, html, langid, lm, minhash, packing, periodic, quality, records, spelling, toxicity, vector_links
from seqloom.llm.common import id_remainder, table, text_of
from seqloom.llm.tokens import tokenizer_path

WORD_TOKENIZER, WORD_END = "word_bpe_49k.json", 2
BYTE_TOKENIZER, BYTE_END = "byte_bpe_50k.json", 0
CAPACITY = 2048


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = records.write_token_records(docs, tokenizer_path(WORD_TOKENIZER), False, WORD_END)
    return records.read_token_records(files, with_ids=False)


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _with_prediction(scores, 0.3)


def _with_prediction(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        (id_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(shingle=4))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _with_prediction(toxicity.score(docs, model, ["doc_id"]), 0.5)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=1)
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "place")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path(BYTE_TOKENIZER), True, BYTE_END, CAPACITY)
    return packing.pack_pieces(pieces, CAPACITY)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm.language_model_scores(docs, id_remainder(7) != 2)
    return scores.select(
        "doc_id", (id_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def typed_words(docs: DataFrame) -> DataFrame:
    """word: the letter runs of documents, A-Z lower-cased; where 31 divides the crc32 of ``<id>:<run>``,
    one letter is missing. An unknown id counts as an empty one. Runs too short to matter are left out."""
    runs = docs.select("doc_id", F.explode(spelling.letter_runs(F.col("text"), 7)).alias("run"))
    runs = runs.select("doc_id", spelling.lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    shorter = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return hashed.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(typed_words(table(spark, sf_dir, "documents")))
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 (polynomial 3988292384) of the bytes in a list: each byte is followed by eight shifts, marked -1.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform({bytes},
  lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""
_UTF8 = """flatten(list_transform(range(1, length({text}) + 1), lambda i:
  CASE WHEN unicode(substr({text}, i, 1)) < 128 THEN [unicode(substr({text}, i, 1))]
  ELSE [192 + (unicode(substr({text}, i, 1)) >> 6), 128 + (unicode(substr({text}, i, 1)) & 63)] END))"""

OP11_SQL = (
    """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs WHERE length(run) >= 7 GROUP BY ALL
), named AS (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS t FROM low
), hashed AS (SELECT run, k, """
    + _CRC.format(bytes=_UTF8.format(text="t"))
    + """ AS h FROM named
), typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed
), words AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(near := near, near_n := near_n), struct_pack(r := -near_n, near := near)) AS b FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT way.word, formed.form, step + 1 FROM way JOIN formed ON formed.word = way.root WHERE formed.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
)


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, text: in texts whose crc32 of the id ends in 0, a stretch of words is repeated to the end.

    With g the crc32 without its last digit and n words: word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). An unknown id leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(text_of(), F.lit(r"[^\x20\x09-\x0D]+"), 0))
    listed = docs.select("doc_id", "text", h.alias("h")).withColumn("words", words).withColumn("g", F.expr("h div 10"))
    placed = listed.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    changed = F.expr(
        """concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))"""
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeated_words(table(spark, sf_dir, "documents")))
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate(
        "runs", F.lit(None).cast(kind), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = (
    """
WITH hashed AS (
  SELECT doc_id, """
    + _CRC.format(bytes="list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: unicode(substr(doc_id::VARCHAR, i, 1)))")
    + """ AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS own FROM documents
), sized AS (SELECT doc_id, h, h // 10 AS g, own, length(own) AS n FROM hashed
), placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized
), cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), spaced AS (SELECT doc_id, h, own, n, a, p, unnest(range(0, n)) AS i FROM cut
), w AS (SELECT doc_id, n, i, own[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM spaced
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
), ranked AS (
  SELECT a.*, (SELECT count(*) FROM runs b WHERE a.doc_id = b.doc_id AND (b.length * a.q > a.length * b.q
    OR (b.length * a.q = a.length * b.q AND (b.start < a.start OR (b.start = a.start AND b.q < a.q))))) AS before FROM runs a
), dropped AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length
), kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.start, r.length, r.q AS period, (1000 * r.length) // r.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN (SELECT * FROM ranked WHERE before = 0) r ON d.doc_id = r.doc_id
LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
)


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.linked_vectors(table(spark, sf_dir, "embeddings"), 0.98)


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), fine AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND length(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND length(a.x) = length(b.x)
  AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
), reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), comps AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u
), counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT c.u AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.u = component_id AS kept FROM comps c LEFT JOIN counts k ON c.u = k.u
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction,
            op2_token_records,
            op3_quality_discriminant,
            op4_exact_dedup,
            op5_minhash_near_dedup,
            op6_language_id,
            op7_toxicity,
            op8_benchmark_decontamination,
            op9_best_fit_packing,
            op10_language_model,
            op11_spelling_variants,
            op12_periodic_runs,
            op13_embedding_links,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": OP4_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_periodic_runs": OP12_SQL,
        "op13_embedding_links": OP13_SQL,
    }
