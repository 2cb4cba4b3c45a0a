"""Line-JSON reviews and item metadata."""

from __future__ import annotations

import ast
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqloom.functions import text as T
from seqloom.session import materialize

RECORD = "record"
ORDER = "line_order"
_IS_JSON = "_is_json"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with ``line_order``, which sorts like the lines of the input.

    Compressed files are read by one task each; their lines are spread before parsing.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = (
        spark.read.text(paths)
        .select(
            "value",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(ORDER),
        )
        .filter(F.trim("value") != "")
    )
    if any(p.endswith(".gz") for p in paths):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    return lines


def _plain(value):
    """What JSON can hold: sets and tuples as lists, numbers that are none as null, bytes as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return [_plain(v) for v in sorted(value, key=repr)]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _repaired(line: str) -> tuple[str | None, str | None]:
    """A record as JSON text, or why there is none."""
    for parse in (json.loads, ast.literal_eval):
        try:
            value = parse(line.strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        return (json.dumps(_plain(value)), None) if isinstance(value, dict) else (None, "not a record")
    return None, "neither JSON nor a literal"


def _repair(frames):
    for frame in frames:
        found = [_repaired(line) for line in frame["value"]]
        yield frame.assign(again=[f[0] for f in found], reason=[f[1] for f in found])


@dataclass(frozen=True)
class ParsedLines:
    """``records``: lines with their record; ``rejected``: the other lines and the reason."""

    records: DataFrame
    rejected: DataFrame


def split_records(lines: DataFrame) -> ParsedLines:
    """Every line goes to ``records`` (strict JSON, else a Python literal) or to ``rejected``.

    Lines that are no JSON objects are written apart; of these, only lines that are no JSON at all are
    handed to Python. Non-finite numbers become null, sets and tuples lists.
    """
    strict = lines.withColumn(RECORD, F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant(RECORD).startswith("OBJECT"), F.lit(False))
    other = strict.filter(~is_object).select(*lines.columns, F.col(RECORD).isNotNull().alias(_IS_JSON))
    other = materialize(other, "failed-lines")
    failed = other.filter(~F.col(_IS_JSON)).drop(_IS_JSON)
    schema = StructType([*failed.schema.fields, StructField("again", StringType()), StructField("reason", StringType())])
    tried = materialize(failed.filter(F.col("value").isNotNull()).mapInPandas(_repair, schema), "repaired-lines")
    again = tried.withColumn(RECORD, F.try_parse_json("again"))
    repaired = again.filter(F.col(RECORD).isNotNull()).select(*lines.columns, RECORD)
    reason = F.coalesce("reason", F.lit("no JSON value can hold the record"))
    rejected = again.filter(F.col(RECORD).isNull()).select(*lines.columns, reason.alias("reason"))
    missing = failed.filter(F.col("value").isNull()).select(*lines.columns, F.lit("no line").alias("reason"))
    plain = other.filter(_IS_JSON).select(*lines.columns, F.lit("not a record").alias("reason"))
    return ParsedLines(strict.filter(is_object).unionByName(repaired), rejected.unionByName(missing).unionByName(plain))


def parse_records(lines: DataFrame) -> DataFrame:
    """Add ``record`` (variant): strict JSON, else a Python literal; ``split_records`` tells the rest."""
    return split_records(lines).records


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_records(read_lines(spark, path))


def _get(name: str, kind: str) -> Column:
    return F.try_variant_get(RECORD, f"$.{name}", kind)


def text_field(name: str) -> Column:
    """Cleaned text of a string-or-list field; '' when missing."""
    listed = _get(name, "array<string>")
    return F.when(listed.isNotNull(), T.clean_text_list(listed)).otherwise(T.clean_text(_get(name, "string")))


def categories_field(name: str = "categories") -> Column:
    """First path of a list of paths, a plain list, or text."""
    nested = _get(name, "array<array<string>>")
    flat = _get(name, "array<string>")
    return (
        F.when(F.get(nested, F.lit(0)).isNotNull(), T.first_category_path(nested))
        .when(flat.isNotNull(), T.join_categories(flat))
        .otherwise(T.clean_text(_get(name, "string")))
    )


def image_url_field() -> Column:
    """First non-blank URL over the three URL fields, each a string or a list."""
    none = F.array().cast("array<string>")
    parts = []
    for name in T.IMAGE_URL_FIELDS:
        listed = _get(name, "array<string>")
        single = F.array(_get(name, "string"))
        parts.append(F.coalesce(F.when(listed.isNotNull(), listed).otherwise(single), none))
    return T.first_non_blank(F.filter(F.concat(*parts), lambda x: x.isNotNull()))


def review_interactions(records: DataFrame) -> DataFrame:
    """(user_id, item_id, ts); rows without user or item are dropped, bad times become 0."""
    return records.select(
        text_field("reviewerID").alias("user_id"),
        text_field("asin").alias("item_id"),
        F.coalesce(_get("unixReviewTime", "bigint"), F.lit(0).cast("bigint")).alias("ts"),
    ).filter((F.col("user_id") != "") & (F.col("item_id") != ""))


def read_interactions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return review_interactions(read_records(spark, path))


def _last_per_item(found: DataFrame, item_map: DataFrame) -> DataFrame:
    """The last record of each catalogue item, over all lines.

    Records are reduced to one per item, before the shuffle where they can be, and then meet the
    catalogue.
    """
    payload = [c for c in found.columns if c not in ("item_id", ORDER)]
    last = found.groupBy("item_id").agg(F.max_by(F.struct(*payload), ORDER).alias("_r"))
    return last.join(item_map.select("item_id", "item_idx"), "item_id").select("item_idx", "item_id", "_r.*")


def item_metadata(records: DataFrame, item_map: DataFrame) -> DataFrame:
    """(item_idx, item_id, title, categories, image_url) of catalogue items with metadata."""
    found = records.select(
        text_field("asin").alias("item_id"),
        ORDER,
        text_field("title").alias("title"),
        categories_field().alias("categories"),
        image_url_field().alias("image_url"),
    ).filter(F.col("item_id") != "")
    return _last_per_item(found, item_map)


def item_texts(records: DataFrame, item_map: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(item_idx, item_id, text, has_meta) for the whole catalogue; the id stands in for missing text.

    With ``max_chars`` description and feature are cut after so many characters.
    """
    cut = (lambda c: c) if max_chars is None else (lambda c: T.truncate_text(c, max_chars))
    fields = {
        "title": text_field("title"),
        "brand": text_field("brand"),
        "categories": categories_field(),
        "description": cut(text_field("description")),
        "feature": cut(text_field("feature")),
    }
    found = records.select(
        text_field("asin").alias("item_id"), ORDER, *[c.alias(name) for name, c in fields.items()]
    ).filter(F.col("item_id") != "")
    last = _last_per_item(found, item_map)
    texts = last.select("item_idx", T.item_text({f: F.col(f) for f in fields}, "item_id").alias("text"))
    return item_map.select("item_idx", "item_id").join(texts, "item_idx", "left").select(
        "item_idx", "item_id", F.coalesce("text", "item_id").alias("text"), F.col("text").isNotNull().alias("has_meta")
    )


def image_hints(records: DataFrame, item_map: DataFrame) -> DataFrame:
    """(item_idx, item_id, image_url, image_filename, image_path) of catalogue items with metadata."""
    found = records.select(
        text_field("asin").alias("item_id"),
        ORDER,
        image_url_field().alias("image_url"),
        text_field("image_path").alias("image_path"),
    ).filter(F.col("item_id") != "")
    return _last_per_item(found, item_map).withColumn("image_filename", T.file_name_of_url("image_url"))


def coverage(table: DataFrame, flag: Column) -> DataFrame:
    """(found, missing) rows by a boolean column."""
    return table.agg(F.count_if(flag).alias("found"), F.count_if(~flag).alias("missing"))
