"""Sample counts per split, write plans, chunk numbering and dataset statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.ordering import running_totals

SPLITS = ("train", "val", "test")


def _per_user(n: Column, mode: str) -> dict[str, Column]:
    if mode == "none":
        return {"train": F.greatest(n - 1, F.lit(0))}
    return {
        "train": F.greatest(n - 3, F.lit(0)),
        "val": (n >= 3).cast("bigint"),
        "test": (n >= 2).cast("bigint"),
    }


def user_sizes(indexed: DataFrame, user: str = "user_idx") -> DataFrame:
    return indexed.groupBy(user).agg(F.count(F.lit(1)).alias("seq_len"))


def split_counts(sizes: DataFrame, mode: str = "leave_last_two") -> DataFrame:
    """(split, raw_count) from sequence lengths alone; no sample is built."""
    parts = _per_user(F.col("seq_len"), mode)
    sums = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in parts.items()])
    return sums.unpivot([], list(parts), "split", "raw_count")


def write_plan(counts: DataFrame, chunk_size: int = 1000, max_samples: int = 0, drop_tail: bool = False) -> DataFrame:
    """Samples and chunks to write per split; all of them, the last chunk being shorter.

    ``max_samples`` (0: no cap) caps a split, and ``drop_tail`` leaves out what fills no whole chunk;
    ``dropped_tail`` counts what either leaves out.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    wanted = F.least("raw_count", F.lit(max_samples)) if max_samples > 0 else F.col("raw_count")
    full = F.floor(wanted / chunk_size)
    planned = counts.select("split", "raw_count", full.alias("full_chunks"), (full * chunk_size if drop_tail else wanted).alias("samples_to_write"))
    return planned.select(
        "split",
        "raw_count",
        "samples_to_write",
        "full_chunks",
        F.ceil(F.col("samples_to_write") / chunk_size).alias("chunks"),
        (F.col("raw_count") - F.col("samples_to_write")).alias("dropped_tail"),
    )


def assign_chunks(
    samples: DataFrame,
    sizes: DataFrame,
    chunk_size: int = 1000,
    max_samples: int = 0,
    mode: str = "leave_last_two",
    user: str = "user_idx",
    drop_tail: bool = False,
) -> DataFrame:
    """Add ``chunk_id`` and ``slot`` in (user, pos) order per split; only what ``write_plan`` writes.

    The place of a sample in its split follows from the samples of all earlier users, so only
    the user table is ordered; the samples are not sorted again.
    """
    parts = _per_user(F.col("seq_len"), mode)
    per_user = sizes.select(user, *[c.alias(name) for name, c in parts.items()])
    before = running_totals(per_user, user, list(parts)).select(
        user, *[f"{name}_before" for name in parts]
    )
    inside = F.when(F.col("split") == "train", F.col("pos") - 1).otherwise(0)
    start = reduce(
        lambda acc, name: acc.when(F.col("split") == name, F.col(f"{name}_before")), parts, F
    )
    plan = write_plan(split_counts(sizes, mode), chunk_size, max_samples, drop_tail)
    numbered = samples.join(before, user).withColumn("_n", (start + inside).cast("bigint"))
    return (
        numbered.join(F.broadcast(plan.select("split", "samples_to_write")), "split")
        .filter(F.col("_n") < F.col("samples_to_write"))
        .select(
            *samples.columns,
            F.expr(f"_n div {chunk_size}").alias("chunk_id"),
            (F.col("_n") % chunk_size).cast("int").alias("slot"),
        )
    )


def sample_bytes(history_len: int = 50) -> int:
    """Stored size of one sample: 4-byte ids, 1-byte mask, 4-byte user and target."""
    return history_len * 5 + 8


def dataset_stats(
    sizes: DataFrame,
    item_map: DataFrame,
    history_len: int = 50,
    chunk_size: int = 1000,
    k: int = 5,
    max_samples: int = 0,
    mode: str = "leave_last_two",
    drop_tail: bool = False,
) -> DataFrame:
    """One row of dataset totals and the estimated stored size, without building samples."""
    plan = write_plan(split_counts(sizes, mode), chunk_size, max_samples, drop_tail)
    totals = plan.agg(
        F.sum("raw_count").alias("total_samples"),
        F.sum("samples_to_write").alias("samples_written"),
        F.sum("dropped_tail").alias("dropped_tail"),
        F.sum("chunks").alias("chunks_written"),
    )
    return totals.select(
        F.lit(history_len).alias("history_len"),
        F.lit(chunk_size).alias("chunk_size"),
        F.lit(k).alias("k_core"),
        F.lit(mode).alias("split_mode"),
        sizes.agg(F.count(F.lit(1))).scalar().alias("num_users"),
        item_map.agg(F.count(F.lit(1))).scalar().alias("num_items"),
        "total_samples",
        "samples_written",
        "dropped_tail",
        "chunks_written",
        (F.col("samples_written") * sample_bytes(history_len)).alias("approx_bytes"),
    )
