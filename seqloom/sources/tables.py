"""Stored tables: vectors, samples, codes and id maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from seqloom.functions.text import parse_code_key
from seqloom.operators.checks import vector_shape
from seqloom.operators.ordering import running_totals
from seqloom.operators.sampling import gaussian
from seqloom.session import materialize


def read_vectors(spark: SparkSession, path: str, expected_rows: int | None = None, dim: int | None = None) -> DataFrame:
    """(item_idx, vec as float array); raises when the shape is not the expected one."""
    vectors = spark.read.parquet(path).select(
        F.col("item_idx").cast("int").alias("item_idx"), F.col("vec").cast("array<float>").alias("vec")
    )
    shape = vector_shape(vectors)
    if (expected_rows is not None and shape.rows != expected_rows) or (dim is not None and shape.dim != dim):
        raise ValueError(f"expected {expected_rows} x {dim} vectors, got {shape.rows} x {shape.dim}")
    return vectors


def dummy_vectors(item_map: DataFrame, dim: int = 128, seed: int = 0) -> DataFrame:
    """Standard normal vectors that depend only on seed, item index and dimension."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    vec = F.transform(places, lambda d: gaussian(seed, F.col("item_idx"), d).cast("float"))
    return item_map.select("item_idx", vec.alias("vec"))


def split_root(spark: SparkSession, root: str, split: str) -> str:
    """Where the samples of a split are: ``<root>/<split>``, else ``<root>/split=<split>``, else
    ``<root>`` itself; the first of them that holds Parquet files, directly or in chunk folders."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for folder in (f"{root}/{split}", f"{root}/split={split}", root):
        files = Path(f"{folder}/{{*.parquet,chunk_*/*.parquet}}")
        if files.getFileSystem(conf).globStatus(files):
            return folder
    raise ValueError(f"no samples for split {split!r} under {root}")


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stored samples, whole or of one split (pruned by folder).

    A split is read from its ``split_root``; where that is ``path`` itself, the rows of the split are
    taken, or all rows when the table has no column ``split``.
    """
    if split is None:
        return spark.read.parquet(path)
    root = split_root(spark, path, split)
    if root == f"{path}/split={split}":  # read from the top, so that the folder's value becomes a column
        return spark.read.parquet(path).filter(F.col("split") == split)
    samples = spark.read.option("recursiveFileLookup", True).parquet(root)
    if root == f"{path}/{split}" or "split" not in samples.columns:
        return samples
    chosen = samples.filter(F.col("split") == split)
    if chosen.isEmpty():
        raise ValueError(f"no samples for split {split!r} under {path}")
    return chosen


def in_chunk_order(samples: DataFrame) -> DataFrame:
    return samples.orderBy("chunk_id", "slot")


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(item_idx, item_id, code)."""
    return spark.read.parquet(path)


def _json_strings(spark: SparkSession, path: str) -> DataFrame:
    """n, text, after: the strings of one JSON file in order, and what stands between each and the next.

    The file may be laid out in any way, and no task holds more of it than its byte range. Records end
    at every quotation mark. One that an odd number of backslashes precedes belongs to the string it
    is in; all others open and close strings in turn. So the number of such marks before a record, the
    sum over earlier ranges and over the records before it in its own range, tells what the record is.
    """
    pieces = spark.read.option("lineSep", '"').text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    backslashes = F.length("value") - F.length(F.rtrim("value", F.lit("\\")))
    pieces = materialize(pieces.withColumn("ends", (backslashes % 2 == 0).cast("int")), "json-pieces")
    ranges = pieces.groupBy("file", "start").agg(F.sum("ends").alias("marks"))
    if ranges.select("file").distinct().count() > 1:
        raise ValueError(f"{path} is more than one file")
    # One row per byte range of the file: the window and the broadcast are bounded by their number.
    earlier = W.orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("start", F.coalesce(F.sum("marks").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("start").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.join(F.broadcast(offsets), "start").select(
        "start", "row", "value", (F.col("before") + F.coalesce(F.sum("ends").over(inside), F.lit(0))).alias("t")
    )
    # Mark number 2n + 1 opens string n; what follows its end has number 2n + 2.
    held = placed.filter("t > 0").groupBy(F.expr("(t - 1) div 2").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("t", "start", "row", "value"))).alias("p")
    )

    def part(odd: int) -> Column:
        return F.array_join(F.transform(F.filter("p", lambda x: x["t"] % 2 == odd), lambda x: x["value"]), '"')

    text = F.get(F.from_json(F.concat(F.lit('["'), part(1), F.lit('"]')), "array<string>"), F.lit(0))
    return held.select("n", text.alias("text"), part(0).alias("after"))


def _entries(strings: DataFrame, value: str, kind: str) -> DataFrame:
    """(k, v) where every string is a key and its value holds no string."""
    found = F.regexp_extract("after", rf"(?s)^\s*:\s*({value})\s*[,}}]", 1)
    wrong = F.raise_error(F.concat(F.lit("no entry of the expected kind at key "), F.coalesce("text", F.lit("?"))))
    return strings.select(F.col("text").alias("k"), F.from_json(F.when(found != "", F.concat(F.lit('{"v":'), found, F.lit("}"))).otherwise(wrong), f"v {kind}").alias("e")).select(
        "k", F.col("e.v").alias("v")
    )


def read_code_json(spark: SparkSession, path: str) -> DataFrame:
    """{"item id": [1, 2, 3], …} text, in any layout, as (item_id, code)."""
    entries = _entries(_json_strings(spark, path), r"\[[-\d\s,]*\]", "array<int>")
    return entries.select(F.col("k").alias("item_id"), F.col("v").alias("code"))


def read_code_groups_json(spark: SparkSession, path: str) -> DataFrame:
    """{"1-2-3": ["item id", …], …} text, in any layout, as (code_key, code, items)."""
    strings = _json_strings(spark, path)
    is_key = F.col("after").rlike(r"(?s)^\s*:\s*\[")
    is_item = F.col("after").rlike(r"(?s)^\s*(,|\]\s*[,}])")
    wrong = F.raise_error(F.concat(F.lit("neither a key nor an item: "), F.coalesce("text", F.lit("?"))))
    marked = strings.select("n", "text", F.when(is_key, 1).when(is_item, 0).otherwise(wrong.cast("int")).alias("key"))
    numbered = running_totals(marked, "n", ["key"]).withColumn("entry", F.col("key_before") + F.col("key"))
    items = F.sort_array(F.collect_list(F.when(F.col("key") == 0, F.struct("n", "text"))))
    grouped = numbered.groupBy("entry").agg(F.max(F.when(F.col("key") == 1, F.col("text"))).alias("code_key"), items["text"].alias("items"))
    return grouped.select("code_key", parse_code_key("code_key").alias("code"), "items")


def read_id_map_json(spark: SparkSession, path: str, id_name: str = "item_id", index_name: str = "item_idx") -> DataFrame:
    """{"id": 0, …} text, in any layout, as (id, index)."""
    entries = _entries(_json_strings(spark, path), r"-?\d+", "int")
    return entries.select(F.col("k").alias(id_name), F.col("v").alias(index_name))
