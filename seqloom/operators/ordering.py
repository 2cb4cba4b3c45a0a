"""Global order without a single-task window: dense indexes, prefix sums, as-of lookup.

A range-partitioned, sorted table is written once (range boundaries are sampled, so they
must not be drawn twice); per-partition totals, one row per partition, give the offsets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqloom.session import materialize

_ROW_BITS = 33  # fixed value: monotonically_increasing_id keeps the row number in 33 bits
PART, ROW = "_part", "_row"


def range_sorted(df: DataFrame, keys: list[str], label: str = "sorted") -> DataFrame:
    """Globally sort and write ``df``; adds the range number ``_part`` and row ``_row`` in it."""
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return (
        materialize(placed, label)
        .withColumn(PART, F.shiftright("_place", _ROW_BITS))
        .withColumn(ROW, F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_place")
    )


def _with_offsets(df: DataFrame, part: str, totals: dict[str, Column]) -> DataFrame:
    """Add ``_before_<name>``: the sum of each total over all earlier partitions."""
    # One row per partition: the window and the broadcast are bounded by the partition count.
    per_part = df.groupBy(part).agg(*[total.alias(name) for name, total in totals.items()])
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        part,
        *[
            F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )
    return df.join(F.broadcast(offsets), part)


def number_rows(df: DataFrame, keys: list[str], out: str, dtype: str = "bigint") -> DataFrame:
    """Number all rows 0, 1, 2, … in the order of ``keys``.

    The row counts of the ranges, one number per range, are summed up here and enter the plan
    as one array value, so that reading the result is a plain scan.
    """
    placed = range_sorted(df, keys, "numbered")
    counts = dict(placed.groupBy(PART).agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    start = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), F.col(PART))
    return placed.select(*df.columns, (start + F.col(ROW)).cast(dtype).alias(out))


def dense_index(
    df: DataFrame, key: str, out: str, dtype: str = "int", distinct: bool = False
) -> DataFrame:
    """Contiguous 0-based ids of the values of ``key``, in ascending order.

    ``distinct`` tells that the values are known to occur once.
    """
    values = df.select(key)
    return number_rows(values if distinct else values.distinct(), [key], out, dtype)


def running_totals(
    df: DataFrame, index: str, values: list[str], block_rows: int = 65536
) -> DataFrame:
    """Add ``<value>_before``: the sum of ``value`` over all rows with a smaller ``index``.

    ``index`` must be a dense 0-based number, so that blocks of consecutive numbers have a
    known size; only block totals are summed in one place.
    """
    blocked = df.withColumn("_block", F.expr(f"{index} div {block_rows}"))
    placed = _with_offsets(blocked, "_block", {v: F.sum(v) for v in values})
    inside = W.partitionBy("_block").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        *df.columns,
        *[
            (F.col(f"_before_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before")
            for v in values
        ],
    )


def last_at_or_before(
    probes: DataFrame, marks: DataFrame, keys: list[str], value: str, salt: str
) -> DataFrame:
    """For each probe, the ``value`` of the last mark whose ``keys`` are <= the probe's.

    ``keys`` (compared left to right) exist on both sides; ``salt`` is a probe column that
    spreads equal probes over ranges. Both sides are sorted together, so neither a hot key
    nor a dense stretch of marks can pair up rows. Marks must be distinct in ``keys``.
    """
    extra = [c for c in probes.columns if c not in keys]
    schema = probes.schema
    mark_rows = marks.select(
        *keys,
        F.lit(0).alias("_kind"),
        F.lit(0).cast("bigint").alias("_salt"),
        F.col(value).alias("_mark"),
        *[F.lit(None).cast(schema[c].dataType).alias(c) for c in extra],
    )
    probe_rows = probes.select(
        *keys,
        F.lit(1).alias("_kind"),
        F.col(salt).cast("bigint").alias("_salt"),
        F.lit(None).cast(marks.schema[value].dataType).alias("_mark"),
        *extra,
    )
    placed = range_sorted(mark_rows.unionByName(probe_rows), [*keys, "_kind", "_salt"], "asof")
    seen = W.partitionBy(PART).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
    # Last mark of each range, one row per range, handed on to the ranges after it.
    tails = placed.groupBy(PART).agg(
        F.max_by("_mark", F.when(F.col("_kind") == 0, F.col(ROW))).alias("_tail")
    )
    handed = tails.select(
        PART,
        F.last("_tail", ignorenulls=True)
        .over(W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1))
        .alias("_carry"),
    )
    return (
        placed.withColumn("_here", F.last("_mark", ignorenulls=True).over(seen))
        .filter(F.col("_kind") == 1)
        .join(F.broadcast(handed), PART)
        .select(*probes.columns, F.coalesce("_here", "_carry").alias(value))
    )
