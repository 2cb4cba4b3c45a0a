"""Column names and column sets handed to a trainer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.checks import TOKENIZED_COLUMNS, require_columns, vector_shape
from seqloom.operators.gather import MAX_BROADCAST_BYTES, as_lists, as_matrix
from seqloom.session import materialize

_TASK_ROWS = 1_000_000  # samples that share one copy of the vectors they use, on average
_LEAST_ROWS = 10_000
_SLOT_BYTES = 16 << 20  # of history vectors put together at once inside a task

# Accepted spellings of a column, and the optional vector columns of a batch.
ALIASES = {
    "target_item_ids": ("target_item_ids", "target_item_id"),
    "history_masks": ("history_masks", "history_mask"),
    "seq_lengths": ("seq_lengths", "seq_length"),
}
OPTIONAL_COLUMNS = (
    "history_text_embeds",
    "target_text_embed",
    "pooled_text_embed",
    "history_image_embeds",
    "target_image_embed",
    "pooled_image_embed",
    "history_cf_embeds",
    "target_cf_embed",
    "pooled_cf_embed",
    "target_item_latent",
)


def normalize_columns(batch: DataFrame) -> DataFrame:
    """One spelling per column; the first spelling present wins."""
    require_columns(batch, ("input_ids", "attention_mask"))
    spare = {name for names in ALIASES.values() for name in names}
    plain = [F.col(c) for c in batch.columns if c not in spare]
    merged = []
    for wanted, names in ALIASES.items():
        present = [n for n in names if n in batch.columns]
        if present:
            merged.append(F.col(present[0]).alias(wanted))
    return batch.select(*plain, *merged)


def assemble_batch(samples: DataFrame) -> DataFrame:
    """Required columns, then whichever optional ones are there."""
    require_columns(samples, TOKENIZED_COLUMNS)
    optional = [c for c in OPTIONAL_COLUMNS if c in samples.columns]
    return samples.select(*TOKENIZED_COLUMNS, *optional)


def _vector_or_zeros(item: str, vec: str, name: str, dim: int) -> Column:
    """The vector of an item; zeros for a negative item, an error for an item that has none."""
    unknown = F.raise_error(F.format_string(f"item %d has no {name} vector", F.col(item))).cast("array<float>")
    return F.when(F.col(item) < 0, F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(F.coalesce(F.col(vec), unknown))


def _gather_in_batches(samples: DataFrame, wide: DataFrame, dims: dict[str, int], history: str, mask: str) -> DataFrame:
    """Add the history columns of the branches named in ``dims`` from a small table that travels with the tasks."""
    table = _BranchTable.of(wide.select("item_idx", *dims).toArrow(), dims)
    shared = samples.sparkSession.sparkContext.broadcast(table)
    rows, schema = _slotted(samples, dims, history, mask)

    def run(batches):
        for batch in batches:
            yield from _gathered(batch, shared.value, dims, schema.names)

    return rows.mapInArrow(run, schema)


def _slotted(samples: DataFrame, dims: dict[str, int], history: str, mask: str, targets: tuple[str, ...] = ()):
    """Samples with the items of their history slots, -1 where a slot has none, and the schema of what ``_gathered`` makes of them."""
    wanted = F.transform(history, lambda x, i: F.when(F.get(mask, i).cast("boolean") & (x >= 0), x).otherwise(-1).cast("bigint"))
    rows = samples.withColumn("_slots", F.coalesce(wanted, F.array().cast("array<bigint>")))
    added = {f"history_{b}_embeds": "array<array<float>>" for b in dims} | {f"pooled_{b}_embed": "array<double>" for b in dims}
    added |= {_target_column(name): "array<float>" for name in targets}
    return rows, samples.withColumns({name: F.lit(None).cast(kind) for name, kind in added.items()}).schema


@dataclass(frozen=True)
class _BranchTable:
    """Ids in ascending order and, by branch, their vectors and who has one; the last row answers slots without an item."""

    ids: np.ndarray
    branches: dict[str, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(held: pa.Table, dims: dict[str, int]) -> "_BranchTable":
        ids = held["item_idx"].to_numpy()
        if (ids[1:] < ids[:-1]).any():
            held = held.sort_by("item_idx")
        branches = {}
        for name, dim in dims.items():
            column = held[name].combine_chunks()
            has = np.append(column.is_valid().to_numpy(zero_copy_only=False), True)
            table = np.zeros((held.num_rows + 1, dim), np.float32)
            table[np.flatnonzero(has[:-1])] = as_matrix(column.drop_null(), np.float32).reshape(-1, dim)
            branches[name] = (table, has)
        return _BranchTable(held["item_idx"].to_numpy().astype(np.int64), branches)

    def places(self, items: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, items)
        lost = items >= 0
        if len(self.ids):
            lost &= self.ids[np.minimum(at, len(self.ids) - 1)] != items
        if lost.any():
            raise ValueError(f"item {items[lost][0]} has no {' or '.join(self.branches)} vector")
        return np.where(items >= 0, at, len(self.ids))


def _target_column(name: str) -> str:
    return "target_item_latent" if name == "latent" else f"target_{name}_embed"


def _gathered(batch: pa.RecordBatch, table: _BranchTable, dims: dict[str, int], names: list[str], target: str | None = None):
    """A batch with ``_slots`` in pieces that carry their history vectors and pooled ones, and with ``target`` those of their targets."""
    longest = max((n for n in batch.column("_slots").value_lengths().to_pylist()), default=0)
    step = max(1, _SLOT_BYTES // max(1, longest * sum(dims.values()) * 4))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        slots = part.column("_slots")
        items, ends = slots.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())])
        at, sizes = table.places(items), np.diff(ends)
        used = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[items >= 0], minlength=len(sizes))
        columns = {}
        if target is not None:
            goals = part.column(target)
            if goals.null_count:
                raise ValueError("a sample has no target")
            goals = goals.to_numpy().astype(np.int64)
            goal_at = table.places(np.maximum(goals, -1))
            for name, (vectors, has) in table.branches.items():
                if not has[goal_at].all():
                    raise ValueError(f"item {goals[~has[goal_at]][0]} has no {name} vector")
                columns[_target_column(name)] = as_lists(vectors[goal_at])
        for name in dims:
            vectors, has = table.branches[name]
            if not has[at].all():
                raise ValueError(f"item {items[~has[at]][0]} has no {name} vector")
            vecs = vectors[at]
            total = np.zeros((len(sizes), vectors.shape[1]))
            for step_at in range(sizes.max(initial=0)):
                own = np.flatnonzero(sizes > step_at)
                total[own] += vecs[ends[own] + step_at]
            columns[f"history_{name}_embeds"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), as_lists(vecs))
            columns[f"pooled_{name}_embed"] = as_lists(total * (1.0 / np.maximum(used, 1))[:, None])
        yield pa.RecordBatch.from_arrays([columns[n] if n in columns else part.column(n) for n in names], names)


def _gather_by_task(
    samples: DataFrame, wide: DataFrame, dims: dict[str, int], branches: list[str], key: list[str], history: str, mask: str, target: str, task_rows: int
) -> DataFrame:
    """All columns of all tables in ``dims`` from a large table: each task of samples is sent the items it uses, each once, ahead of its samples."""
    own = {b: dims[b] for b in branches}
    rows, schema = _slotted(samples, own, history, mask, tuple(dims))
    rows = materialize(rows, "branch-samples")  # narrow; read twice
    n = rows.count()
    # However many tasks, no more items travel than slots are filled.
    tasks = max(1, -(-n // task_rows), min(2 * rows.sparkSession.sparkContext.defaultParallelism, n // _LEAST_ROWS))
    names = rows.columns
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int"))
    items = F.concat("_slots", F.array(F.col(target).cast("bigint")))
    used = dealt.select("_task", F.explode(items).alias("item_idx")).filter("item_idx >= 0").distinct()
    vectors = used.join(wide.select(F.col("item_idx").cast("bigint").alias("item_idx"), *dims), "item_idx")
    # In every task vectors come first (kind 0), by item.
    one = vectors.select("_task", F.lit(0).alias("_kind"), F.struct("item_idx", *dims).alias("_vector"))
    two = dealt.select("_task", F.lit(1).alias("_kind"), F.struct(*names).alias("_row"))
    both = one.unionByName(two, True).repartitionById(tasks, "_task").sortWithinPartitions("_kind", "_vector.item_idx")

    def run(batches):
        held, table = [], None
        for batch in batches:
            kind = batch.column("_kind").to_numpy()
            n = int(np.searchsorted(kind, 1))
            if n:
                held.append(pa.RecordBatch.from_struct_array(batch.slice(0, n).column("_vector")))
            if n < batch.num_rows:
                if table is None:
                    empty = pa.schema([("item_idx", pa.int64()), *[(d, pa.list_(pa.float32())) for d in dims]])
                    table = _BranchTable.of(pa.Table.from_batches(held) if held else empty.empty_table(), dims)
                    held.clear()
                yield from _gathered(pa.RecordBatch.from_struct_array(batch.slice(n).column("_row")), table, own, schema.names, target)

    return both.mapInArrow(run, schema)


def attach_branches(
    samples: DataFrame,
    branches: dict[str, DataFrame],
    key: list[str],
    latents: DataFrame | None = None,
    history: str = "history_item_ids",
    mask: str = "history_mask",
    target: str = "target_item_ids",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    task_rows: int = _TASK_ROWS,
) -> DataFrame:
    """Add, for every branch (text, image, cf), ``history_<b>_embeds``, ``target_<b>_embed`` and
    ``pooled_<b>_embed``, and ``target_item_latent`` when ``latents`` are given.

    ``branches`` and ``latents`` hold (item_idx, vec). History slots that are masked or negative have
    zeros; the pooled vector is the mean over the others, zeros when there are none. A negative target
    has zeros. An item that is used but has no vector is an error.

    The vectors of all branches are put side by side first and written once. Up to ``max_broadcast_bytes`` they travel
    with the tasks and no sample moves; beyond, samples are dealt to tasks of ``task_rows`` on average, and each task
    is sent every item it uses once, however many slots hold it. Vectors reach the samples in the tasks only.
    """
    unknown = set(branches) - {"text", "image", "cf"}
    if unknown:
        raise ValueError(f"unknown branches {sorted(unknown)}")
    tables = {**branches, **({"latent": latents} if latents is not None else {})}
    if not tables:
        return samples
    shapes = {name: vector_shape(vectors) for name, vectors in tables.items()}
    dims = {name: shape.dim for name, shape in shapes.items()}
    small = sum(shape.rows * (shape.dim * 4 + 8) for shape in shapes.values()) <= max_broadcast_bytes
    wide = None
    for name, vectors in tables.items():
        one = vectors.select("item_idx", F.col("vec").cast("array<float>").alias(name))
        wide = one if wide is None else wide.join(one, "item_idx", "full")
    wide = materialize(wide, "branch-vectors")  # read twice: for histories and for targets

    out = samples
    if branches and small:
        out = _gather_in_batches(samples, wide, {b: dims[b] for b in branches}, history, mask)
    elif branches:
        out = _gather_by_task(samples, wide, dims, list(branches), key, history, mask, target, task_rows)
        return out.select(*samples.columns, *[c for c in OPTIONAL_COLUMNS if c in out.columns and c not in samples.columns])
    renamed = wide.select(F.col("item_idx").alias(target), *[F.col(n).alias(f"_target_{n}") for n in tables])
    out = out.join(F.broadcast(renamed) if small else renamed, target, "left")
    wanted = {_target_column(n): _vector_or_zeros(target, f"_target_{n}", n, d) for n, d in dims.items()}
    out = out.withColumns(wanted)
    added = [c for c in OPTIONAL_COLUMNS if c in out.columns and c not in samples.columns]
    return out.select(*samples.columns, *added)
