"""Text cleaning, item metadata and image names."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.spec import Query
from catalog.tables import table
from seqloom.functions import text as T
from seqloom.operators.ordering import dense_index
from seqloom.sources import images as I, records as R

CLEAN = "trim(regexp_replace({}, '[\\s]+', ' ', 'g'))"
PREVIEW = 80


def _cleaned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.clean_text("text").alias("text"))
    return docs


def _messages(spark, d):
    talk = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m")
    )
    return talk.select("conv_id", T.clean_text_list(F.col("m.role")).alias("roles"))


def _doc_records(spark, d):
    """Documents as metadata lines of their (source, lang) pair; later documents replace earlier."""
    line = F.to_json(
        F.struct(
            F.concat_ws("-", "source", "lang").alias("asin"),
            F.col("text").alias("title"),
            F.array(F.array("lang", F.lit(""), "source"), F.array(F.lit("other"))).alias("categories"),
            F.array(F.lit(" "), F.concat(F.lit("http://x/"), "doc_id", F.lit(".jpg?s=1"))).alias("imageURL"),
        )
    )
    docs = table(spark, d, "documents")
    return R.parse_records(docs.select(line.alias("value"), F.col("doc_id").alias("line_order")))


def _doc_items(spark, d, extra: bool):
    pairs = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("item_id"))
    if extra:
        pairs = pairs.unionByName(table(spark, d, "region").select(F.col("r_name").alias("item_id")))
    return dense_index(pairs, "item_id", "item_idx")


def _metadata(extra: bool):
    return lambda s, d: R.item_metadata(_doc_records(s, d), _doc_items(s, d, extra))


def _metadata_sql(extra: bool) -> tuple[str, ...]:
    more = " UNION SELECT r_name FROM region" if extra else ""
    return (
        f"lines AS (SELECT doc_id, source || '-' || lang AS item_id, {CLEAN.format('text')} AS title, "
        "CASE WHEN lang = '' THEN source ELSE lang || ' > ' || source END AS categories, "
        "'http://x/' || doc_id || '.jpg?s=1' AS image_url FROM documents)",
        f"items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM "
        f"(SELECT item_id FROM lines{more if extra else ' GROUP BY item_id'}))",
        "last AS (SELECT item_id, arg_max(title, doc_id) AS title, arg_max(categories, doc_id) AS categories, "
        "arg_max(image_url, doc_id) AS image_url FROM lines GROUP BY item_id)",
    )


def _part_records(spark, d):
    line = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("asin"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("brand"),
            F.split("p_type", " ").alias("categories"),
            F.array(F.concat(F.lit("size  "), "p_size"), F.lit(""), "p_type").alias("description"),
        )
    )
    return R.parse_records(table(spark, d, "part").select(line.alias("value"), F.col("p_partkey").alias("line_order")))


def _part_texts(spark, d):
    """Parts and suppliers as catalogue; only parts have metadata."""
    ids = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id")).unionByName(
        table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("item_id"))
    )
    return R.item_texts(_part_records(spark, d), dense_index(ids, "item_id", "item_idx"), 20)


TEXTS_SQL = (
    "ids AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part UNION SELECT 'S' || s_suppkey FROM supplier)",
    "items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM ids)",
    "parts AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name, p_brand, replace(p_type, ' ', ' > ') AS cats, "
    "'size ' || p_size || ' ' || p_type AS info FROM part)",
    "texts AS (SELECT item_id, 'title: ' || p_name || ' ; brand: ' || p_brand || ' ; categories: ' || cats || "
    "' ; description: ' || CASE WHEN length(info) > 20 THEN rtrim(left(info, 20)) || '...' ELSE info END AS text FROM parts)",
)


def _image_paths(spark, d):
    """Pages as images of customers: names resolved by path, name and stem."""
    files = table(spark, d, "pages").select(
        F.col("url").alias("path"),
        F.concat(F.col("page_id"), F.lit(".jpg")).alias("rel_path"),
        F.concat(F.col("page_id"), F.lit(".jpg")).alias("name"),
        F.col("page_id").cast("string").alias("stem"),
    )
    ids = dense_index(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id")), "item_id", "item_idx")
    hints = ids.select(
        "item_idx",
        F.concat(F.lit("http://x/"), "item_id", F.lit(".png")).alias("image_url"),
        F.lit("").alias("image_path"),
        F.concat("item_id", F.lit("0.jpg")).alias("image_filename"),
    )
    return ids, hints, I.resolve_images(ids, hints, files)


PATHS_SQL = (
    "ids AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id FROM customer)",
    "items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM ids)",
    "found AS (SELECT item_idx, item_id, coalesce(a.url, b.url) AS path FROM items "
    "LEFT JOIN pages a ON CAST(a.page_id AS VARCHAR) = item_id "
    "LEFT JOIN pages b ON CAST(b.page_id AS VARCHAR) = item_id || '0')",
)

QUERIES = [
    Query("clean_text", "doc_id:i text:s", _cleaned, f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents"),
    Query(
        "clean_text_list",
        "conv_id:i roles:s",
        _messages,
        "SELECT conv_id, string_agg(role, ' ' ORDER BY turn, text) AS roles FROM conversations GROUP BY conv_id",
    ),
    Query(
        "truncate_text",
        "doc_id:i text:s",
        lambda s, d: _cleaned(s, d).select("doc_id", T.truncate_text("text", PREVIEW).alias("text")),
        f"SELECT doc_id, CASE WHEN length(t) > {PREVIEW} THEN rtrim(left(t, {PREVIEW})) || '...' ELSE t END AS text "
        f"FROM (SELECT doc_id, {CLEAN.format('text')} AS t FROM documents)",
    ),
    Query(
        "target_text",
        "p_partkey:i text:s",
        lambda s, d: table(s, d, "part").select("p_partkey", T.target_text("p_name", "p_type").alias("text")),
        f"SELECT p_partkey, coalesce(nullif({CLEAN.format('p_name')}, ''), nullif({CLEAN.format('p_type')}, ''), '') AS text FROM part",
    ),
    Query(
        "url_filename",
        "page_id:i name:s",
        lambda s, d: table(s, d, "pages").select("page_id", T.file_name_of_url("url").alias("name")),
        "SELECT page_id, trim(list_last(string_split(string_split(url, '?')[1], '/'))) AS name FROM pages",
    ),
    Query(
        "item_metadata",
        "item_idx:i item_id:s title:s categories:s image_url:s",
        _metadata(False),
        "SELECT item_idx, item_id, title, categories, image_url FROM last JOIN items USING (item_id)",
        _metadata_sql(False),
    ),
    Query(
        "item_metadata_incomplete",
        "item_idx:i item_id:s title:s categories:s image_url:s",
        _metadata(True),
        "SELECT item_idx, item_id, title, categories, image_url FROM last JOIN items USING (item_id)",
        _metadata_sql(True),
    ),
    Query(
        "image_hints",
        "item_idx:i item_id:s image_url:s image_filename:s image_path:s",
        lambda s, d: R.image_hints(_doc_records(s, d), _doc_items(s, d, True)),
        "SELECT item_idx, item_id, image_url, string_split(string_split(image_url, '?')[1], '/')[-1] AS image_filename, "
        "'' AS image_path FROM last JOIN items USING (item_id)",
        _metadata_sql(True),
    ),
    Query(
        "item_text",
        "item_idx:i item_id:s text:s has_meta:b",
        _part_texts,
        "SELECT item_idx, item_id, coalesce(text, item_id) AS text, text IS NOT NULL AS has_meta FROM items LEFT JOIN texts USING (item_id)",
        TEXTS_SQL,
    ),
    Query(
        "text_coverage",
        "found:i missing:i",
        lambda s, d: R.coverage(_part_texts(s, d), F.col("has_meta")),
        "SELECT count(text) AS found, count(*) - count(text) AS missing FROM items LEFT JOIN texts USING (item_id)",
        TEXTS_SQL,
    ),
    Query(
        "image_paths",
        "item_idx:i item_id:s path:s",
        lambda s, d: _image_paths(s, d)[2],
        "SELECT * FROM found",
        PATHS_SQL,
    ),
    Query(
        "image_coverage",
        "found:i missing:i",
        lambda s, d: I.image_coverage(_image_paths(s, d)[2]),
        "SELECT count(path) AS found, count(*) - count(path) AS missing FROM found",
        PATHS_SQL,
    ),
    Query(
        "missing_downloads",
        "item_idx:i item_id:s image_url:s",
        lambda s, d: (lambda x: I.missing_downloads(x[2], x[1]))(_image_paths(s, d)),
        "SELECT item_idx, item_id, 'http://x/' || item_id || '.png' AS image_url FROM found WHERE path IS NULL",
        PATHS_SQL,
    ),
]
