"""Writers: samples, id maps, item store, codes, predictions, metrics and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.operators.checks import require_columns, vector_shape
from seqloom.operators.codes import TokenLayout, code_groups

# Kinds of vectors a manifest may name.
SOURCE_TYPES = ("text", "image", "cf", "vlm", "fusion")

# Stages of a pipeline manifest, their required keys, and the optional ones with defaults.
STAGES = {
    "raw_data": (("dataset_name", "dataset_root", "reviews_path", "meta_path", "image_root"), {"item_embeddings_path": None}),
    "preprocessing": (("output_root", "split_mode", "history_len", "chunk_size"), {"stats_paths": {}}),
    "embeddings": (("source_name", "source_type", "matrix_path", "dim"), {"item_count": None, "metadata": {}}),
    "fusion": (("enabled", "strategy"), {"source_names": [], "output_path": None, "output_dim": None, "metadata": {}}),
    "quantization": (("method", "input_path", "output_root"), {"code_shape": None, "metadata": {}}),
}


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing folder is an error unless ``overwrite``."""
    df.write.mode(_mode(overwrite)).parquet(path)


def write_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder per split, rows in chunk order inside their files."""
    samples.sortWithinPartitions("split", "chunk_id", "slot").write.mode(_mode(overwrite)).partitionBy(
        "split"
    ).parquet(path)


def write_id_maps(user_map: DataFrame, item_map: DataFrame, root: str, overwrite: bool = False) -> None:
    write_table(user_map, f"{root}/user_map", overwrite)
    write_table(item_map, f"{root}/item_map", overwrite)


def write_item_store(vectors: DataFrame, metadata: DataFrame, root: str, overwrite: bool = False) -> None:
    as_float = vectors.select("item_idx", F.col("vec").cast("array<float>").alias("vec"))
    write_table(as_float, f"{root}/item_vectors", overwrite)
    write_table(metadata, f"{root}/item_meta", overwrite)


def write_codes(codes: DataFrame, reconstructed: DataFrame, root: str, manifest: dict, overwrite: bool = False) -> None:
    """Codes, their inverse, the reconstruction and a manifest; ``codes`` carries item ids."""
    write_table(codes, f"{root}/item_codes", overwrite)
    write_table(code_groups(codes), f"{root}/code_items", overwrite)
    write_table(reconstructed, f"{root}/reconstructed", overwrite)
    write_manifest(codes.sparkSession, f"{root}/manifest", "quantization", manifest, overwrite)


def write_tokenized(tokenized: DataFrame, path: str, layout: TokenLayout, overwrite: bool = False) -> dict:
    """Tokenized samples by split, and a manifest with one entry per split."""
    require_columns(tokenized)
    tokenized.write.mode(_mode(overwrite)).partitionBy("split").parquet(f"{path}/samples")
    spark = tokenized.sparkSession
    stored = spark.read.schema(tokenized.schema).parquet(f"{path}/samples")
    rows = stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.max(F.size("history_item_ids")).alias("history_len"),
        F.max(F.size("input_ids")).alias("max_seq_len"),
    ).collect()  # one row per split
    manifest = {
        **layout_manifest(layout),
        "splits": {
            r["split"]: {
                "num_samples": r["num_samples"],
                "history_len": r["history_len"],
                "code_len": layout.code_len,
                "max_seq_len": r["max_seq_len"],
                "path": f"{path}/samples/split={r['split']}",
            }
            for r in rows
        },
    }
    write_manifest(spark, f"{path}/manifest", "tokenization", manifest, overwrite)
    return manifest


def layout_manifest(layout: TokenLayout) -> dict:
    return {
        "code_len": layout.code_len,
        "vocab_sizes": list(layout.vocab_sizes),
        "semantic_offsets": list(layout.offsets),
        "vocab_size": layout.vocab_size,
        "special_tokens": {
            "pad_token_id": layout.pad,
            "mask_token_id": layout.mask,
            "cls_token_id": layout.cls,
            "sep_token_id": layout.sep,
            "eos_token_id": layout.eos,
        },
    }


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object per row, null fields included."""
    df.write.mode(_mode(overwrite)).option("ignoreNullFields", False).json(path)


def metrics_record(by_group: DataFrame, group_summary: DataFrame, settings: dict) -> DataFrame:
    """One nested row: settings, overall metrics, metrics and item summary per group."""
    names = [c for c in by_group.columns if c != "group"]
    rows = by_group.join(group_summary.drop("group_id"), "group", "left")
    entry = F.struct("group", *names, *[c for c in group_summary.columns if c not in ("group", "group_id")])
    overall = F.collect_list(F.when(F.col("group") == "overall", F.struct(*names)))
    return rows.agg(
        overall[0].alias("overall_metrics"),
        F.sort_array(F.collect_list(F.when(F.col("group") != "overall", entry))).alias("group_metrics"),
    ).select(*[F.lit(v).alias(k) for k, v in settings.items()], "overall_metrics", "group_metrics")


def manifest_row(spark: SparkSession, stage: str, payload: dict) -> DataFrame:
    """(stage, payload): the payload as JSON text; vector kinds are checked."""
    for entry in payload.get("artifacts", [payload]):
        kind = entry.get("source_type")
        if kind is not None and kind not in SOURCE_TYPES:
            raise ValueError(f"unknown source type {kind!r}; expected one of {SOURCE_TYPES}")
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, default=str)
    return spark.createDataFrame([(stage, text)], "stage string, payload string")


def write_manifest(spark: SparkSession, path: str, stage: str, payload: dict, overwrite: bool = False) -> None:
    manifest_row(spark, stage, payload).coalesce(1).write.mode(_mode(overwrite)).json(path)


def stage_entry(stage: str, **given) -> dict:
    """One stage's part of a pipeline manifest; missing and unknown keys are errors."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; expected one of {tuple(STAGES)}")
    required, optional = STAGES[stage]
    missing, unknown = [k for k in required if k not in given], [k for k in given if k not in (*required, *optional)]
    if missing or unknown:
        raise ValueError(f"stage {stage!r}: missing keys {missing}, unknown keys {unknown}")
    if stage == "embeddings" and given["source_type"] not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {given['source_type']!r}; expected one of {SOURCE_TYPES}")
    return {k: given.get(k, optional.get(k)) for k in (*required, *optional)}


def vector_stage(vectors: DataFrame, name: str, source_type: str, path: str, **metadata) -> dict:
    """The manifest part of stored vectors; their dimension and number are counted."""
    shape = vector_shape(vectors)
    return stage_entry(
        "embeddings", source_name=name, source_type=source_type, matrix_path=path, dim=shape.dim, item_count=shape.rows, metadata=metadata
    )


def pipeline_manifest(raw_data: dict, preprocessing: dict, embeddings: list[dict] = (), fusion: dict | None = None, quantization: dict | None = None) -> dict:
    """All stages in one payload, each checked; stages not given are null, vectors are a list."""
    checked = lambda stage, given: None if given is None else stage_entry(stage, **given)
    return {
        "raw_data": checked("raw_data", raw_data),
        "preprocessing": checked("preprocessing", preprocessing),
        "embeddings": [checked("embeddings", e) for e in embeddings],
        "fusion": checked("fusion", fusion),
        "quantization": checked("quantization", quantization),
    }


def stats_row(samples: DataFrame, written: DataFrame, settings: dict) -> DataFrame:
    """Per split: samples before chunking, written and dropped, chunks written, users and items in targets;
    ``settings`` become further columns. Both tables are aggregated, never collected."""
    before = samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("total_samples_before_chunk_drop"),
        F.countDistinct("user_idx").alias("num_users"),
        F.countDistinct("target").alias("num_items"),
    )
    kept = written.groupBy("split").agg(F.count(F.lit(1)).alias("total_samples_written"), F.countDistinct("chunk_id").alias("num_chunks_written"))
    both = before.join(kept, "split", "left").fillna(0, ["total_samples_written", "num_chunks_written"])
    dropped = (F.col("total_samples_before_chunk_drop") - F.col("total_samples_written")).alias("dropped_tail_samples")
    return both.select("*", dropped, *[F.lit(v).alias(k) for k, v in settings.items()])
