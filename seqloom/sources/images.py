"""Image files: index by name, resolution per item, download work list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.functions.text import clean_text

EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")  # fixed values, in lookup order


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, name, stem) of image files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    bare = F.regexp_replace("path", r"^[a-zA-Z0-9]+:/*", "/")
    base = root.split(":", 1)[-1] if "://" in root or root.startswith("file:") else root
    prefix = "/" + base.strip("/") + "/"
    named = files.select(
        "path",
        F.substring_index(bare, prefix, -1).alias("rel_path"),
        F.lower(F.substring_index("path", "/", -1)).alias("name"),
    )
    pattern = r"\.(" + "|".join(e[1:] for e in EXTENSIONS) + r")$"
    return named.filter(F.col("name").rlike(pattern)).withColumn(
        "stem", F.regexp_replace("name", r"\.[^.]*$", "")
    )


def index_by(files: DataFrame, key: str) -> DataFrame:
    """(key, path): the smallest path per lower-case name or stem."""
    return files.groupBy(key).agg(F.min("path").alias("path"))


def resolve_images(item_map: DataFrame, hints: DataFrame, files: DataFrame) -> DataFrame:
    """(item_idx, item_id, path): first hit of id + extension, given path, file name, folder
    of the item, name index, stem index; null when there is none."""
    known = item_map.select("item_idx", "item_id").join(
        hints.select("item_idx", "image_path", "image_filename"), "item_idx", "left"
    )
    path, name = clean_text("image_path"), clean_text("image_filename")
    exact = [F.concat("item_id", F.lit(e)) for e in EXTENSIONS]
    exact += [F.when(path != "", path), F.when(name != "", name)]
    exact += [F.when(name != "", F.concat("item_id", F.lit("/"), name))]
    lookups = [("rel_path", i, c) for i, c in enumerate(exact)]
    lookups += [("name", len(exact), F.when(name != "", F.lower(name))), ("stem", len(exact) + 1, F.lower("item_id"))]
    wanted = known.select(
        "item_idx",
        F.inline(
            F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("priority"), c.alias("key")) for kind, p, c in lookups])
        ),
    ).filter(F.col("key").isNotNull())
    offered = None
    for kind in ("rel_path", "name", "stem"):
        part = index_by(files, kind).select(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "path")
        offered = part if offered is None else offered.unionByName(part)
    hits = wanted.join(offered, ["kind", "key"]).groupBy("item_idx").agg(F.min_by("path", "priority").alias("path"))
    return item_map.select("item_idx", "item_id").join(hits, "item_idx", "left")


def missing_downloads(resolved: DataFrame, hints: DataFrame) -> DataFrame:
    """(item_idx, item_id, image_url) of items without a local file but with a URL."""
    urls = hints.select("item_idx", "image_url").filter(clean_text("image_url") != "")
    return resolved.filter(F.col("path").isNull()).select("item_idx", "item_id").join(urls, "item_idx")


def image_coverage(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count_if(F.col("path").isNotNull()).alias("found"), F.count_if(F.col("path").isNull()).alias("missing")
    )
