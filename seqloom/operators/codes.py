"""Semantic item codes: layout, tokenized samples, prefixes and constrained decoding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.text import code_key
from seqloom.operators.gather import as_lists, as_matrix
from seqloom.operators.losses import IGNORE, flat_lists
from seqloom.operators.ordering import number_rows

RESERVED_TOKENS = 5  # fixed value: token ids below this are special
BLOCKED_LOGIT = -1e9  # fixed value: logit of tokens that are not allowed
MAX_LOOKUP_CELLS = 1 << 21
MAX_LIST = 1 << 16
MAX_TRIE_ENTRIES = 1 << 24  # of a prefix table that travels with the tasks
_OPTIONS = 1 << 20  # values weighed at once inside a task
FILL = -1


@dataclass(frozen=True)
class TokenLayout:
    """Token id ranges: special tokens first, then one range per code position."""

    vocab_sizes: tuple[int, ...]
    pad: int = 0
    mask: int = 1
    cls: int = 2
    sep: int = 3
    eos: int = 4

    @property
    def code_len(self) -> int:
        return len(self.vocab_sizes)

    @property
    def offsets(self) -> tuple[int, ...]:
        starts = [RESERVED_TOKENS]
        for size in self.vocab_sizes[:-1]:
            starts.append(starts[-1] + size)
        return tuple(starts)

    @property
    def vocab_size(self) -> int:
        return RESERVED_TOKENS + sum(self.vocab_sizes)

    def max_seq_len(self, history_len: int) -> int:
        return 2 + self.code_len + history_len * (self.code_len + 1)


def vocab_sizes(codes: DataFrame) -> DataFrame:
    """(pos, vocab_size, token_offset): largest used value + 1 and the ids before it."""
    sizes = codes.select(F.posexplode("code").alias("pos", "value")).groupBy("pos").agg(
        (F.max("value") + 1).alias("vocab_size")
    )
    # One row per code position, a handful: a self-join on smaller positions is enough.
    earlier = sizes.select(F.col("pos").alias("_p"), F.col("vocab_size").alias("_v"))
    return (
        sizes.join(F.broadcast(earlier), F.col("_p") < F.col("pos"), "left")
        .groupBy("pos", "vocab_size")
        .agg((F.coalesce(F.sum("_v"), F.lit(0)) + RESERVED_TOKENS).cast("int").alias("token_offset"))
    )


def infer_layout(codes: DataFrame, **special: int) -> TokenLayout:
    """Layout of the used code values; raises when there are no codes or lengths differ."""
    # One row per code position; a code without values shows up as position null.
    rows = (
        codes.select(F.posexplode_outer("code").alias("pos", "value"))
        .groupBy("pos")
        .agg((F.max("value") + 1).alias("size"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    if not rows or any(r["pos"] is None for r in rows):
        raise ValueError("no codes to infer a layout from")
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("codes differ in length")
    return TokenLayout(tuple(r["size"] for r in sorted(rows, key=lambda r: r["pos"])), **special)


def encode_code(code: Column | str, layout: TokenLayout) -> Column:
    """Code values -> token ids; fails on a wrong length or a value out of range."""
    values = F.col(code) if isinstance(code, str) else code
    sizes = F.array(*[F.lit(v) for v in layout.vocab_sizes])
    offsets = F.array(*[F.lit(v) for v in layout.offsets])
    fits = F.forall(F.zip_with(values, sizes, lambda v, s: (v >= 0) & (v < s)), lambda ok: ok)
    valid = (F.size(values) == layout.code_len) & fits
    return F.when(valid, F.zip_with(values, offsets, lambda v, o: v + o)).otherwise(
        F.raise_error(F.concat(F.lit("code does not fit the layout: "), F.to_json(values))).cast("array<int>")
    )


def decode_token(codebook: Column, token: Column, layout: TokenLayout) -> Column:
    """Token id -> code value at a code position."""
    return token - F.array(*[F.lit(v) for v in layout.offsets])[codebook]


def candidate_tokens(codes: DataFrame, layout: TokenLayout) -> DataFrame:
    """(item_idx, codebook, token): the tokens of every catalogue item."""
    return codes.select("item_idx", F.posexplode(encode_code("code", layout)).alias("codebook", "token"))


def code_groups(codes: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(code_key, part, items, n_items): items sharing a code, in index order.

    Lists hold at most ``max_list`` items. Codes shared by more go on in further parts, whose
    items are placed by a global sort instead of being gathered per code.
    """
    keyed = codes.select(code_key("code").alias("code_key"), "item_idx", "item_id")
    sizes = keyed.groupBy("code_key").agg(F.count(F.lit(1)).alias("_n"))
    crowded = sizes.filter(F.col("_n") > max_list)
    if crowded.isEmpty():
        return _listed(keyed.withColumn("part", F.lit(0)))
    numbered = number_rows(keyed.join(crowded, "code_key"), ["code_key", "item_idx"], "_place")
    starts = numbered.groupBy("code_key").agg(F.min("_place").alias("_start"))
    part = F.floor((F.col("_place") - F.col("_start")) / max_list).cast("int")
    crowd = numbered.join(starts, "code_key").select("code_key", "item_idx", "item_id", part.alias("part"))
    rest = keyed.join(crowded, "code_key", "left_anti").withColumn("part", F.lit(0))
    return _listed(rest.unionByName(crowd))


def _listed(keyed: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("item_idx", "item_id")))
    return keyed.groupBy("code_key", "part").agg(
        F.transform(rows, lambda r: r["item_id"]).alias("items"), F.count(F.lit(1)).alias("n_items")
    )


def lookup_codes(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``items`` for each ``code``; an unknown code gives an empty array.

    A code with several parts gives one row per part.
    """
    keyed = wanted.withColumn("code_key", code_key("code"))
    return keyed.join(groups.select("code_key", "items"), "code_key", "left").select(
        *wanted.columns, F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


# ---------------------------------------------------------------- tokenized samples


def _code_reader(samples: DataFrame, codes: DataFrame, layout: TokenLayout, key: list[str], max_cells: int):
    """Rows to tokenize, and a function from an Arrow batch of them to history and target codes.

    A code table of a checked small size travels with the tasks and is looked up per batch;
    otherwise history entries are joined by item and put back in order before.
    """
    top = codes.agg(F.max("item_idx").alias("top")).first()["top"]
    if (top + 1) * layout.code_len > max_cells:
        return _join_codes(samples, codes, layout, key), _read_joined
    held = codes.select("item_idx", "code").toArrow()
    table = np.full((top + 2, layout.code_len), FILL, np.int32)  # the last row answers padding
    table[held["item_idx"].to_numpy()] = as_matrix(held["code"], np.int32)
    shared = samples.sparkSession.sparkContext.broadcast(table)

    def look_up(batch):
        matrix = shared.value
        items, goal = as_matrix(batch.column("history"), np.int64), batch.column("target").to_numpy()
        used = as_matrix(batch.column("mask"), np.bool_) & (items >= 0)
        ok = used & (items < len(matrix) - 1)
        goal = np.where((goal >= 0) & (goal < len(matrix) - 1), goal, len(matrix) - 1)
        found = matrix[np.where(ok, items, len(matrix) - 1)]
        if (found[used] < 0).any():
            raise ValueError("a history item has no code")
        return found, matrix[goal]

    return samples, look_up


def _read_joined(batch):
    history = batch.column("history_semantic_ids")
    goal = as_matrix(batch.column("target_semantic_ids"), np.int32)
    flat = as_matrix(history.flatten(), np.int32)
    return flat.reshape(len(history), -1, goal.shape[1]), goal


def _join_codes(samples: DataFrame, codes: DataFrame, layout: TokenLayout, key: list[str]) -> DataFrame:
    blank = F.array_repeat(F.lit(FILL), layout.code_len)
    steps = F.arrays_zip(F.col("history").alias("item_idx"), F.col("mask").alias("ok"))
    found = (
        samples.select(*key, F.posexplode(steps).alias("step", "e"))
        .filter(F.col("e.ok") & (F.col("e.item_idx") >= 0))
        .select(*key, "step", F.col("e.item_idx").alias("item_idx"))
        .join(codes.select("item_idx", "code"), "item_idx", "left")
        .withColumn("code", F.coalesce("code", F.raise_error(F.lit("a history item has no code"))))
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("step", "code"))).alias("_by_step"))
    )
    goal = codes.select(F.col("item_idx").alias("target"), F.col("code").alias("_goal"))
    slots = F.sequence(F.lit(0), F.size("history") - 1)
    history = F.transform(slots, lambda s: F.coalesce(F.try_element_at("_by_step", s), blank))
    return (
        samples.join(found, key, "left")
        .join(goal, "target", "left")
        .select(
            *samples.columns,
            history.alias("history_semantic_ids"),
            F.coalesce("_goal", blank).alias("target_semantic_ids"),
        )
    )


_TOKEN_TYPES = {
    "input_ids": "array<int>",
    "attention_mask": "array<boolean>",
    "labels": "array<int>",
    "token_slot_ids": "array<int>",
    "token_codebook_ids": "array<int>",
    "seq_lengths": "int",
    "history_item_ids": "array<int>",
    "history_mask": "array<boolean>",
    "target_item_ids": "int",
    "history_semantic_ids": "array<array<int>>",
    "target_semantic_ids": "array<int>",
}


def tokenize_samples(
    samples: DataFrame,
    codes: DataFrame,
    layout: TokenLayout,
    history_len: int,
    key: list[str] | None = None,
    max_lookup_cells: int = MAX_LOOKUP_CELLS,
) -> DataFrame:
    """Token arrays of every sample: [CLS] (codes SEP)* MASK… [EOS] PAD…

    Padded history slots are skipped, so real tokens stand at the left. SEP carries the slot
    of its item and no code position; the target has slot ``history_len``. Labels hold the
    target tokens at the MASK positions. Samples are laid out a whole Arrow batch at a time.
    A history item or target without a code raises an error.
    """
    key = key or [c for c in ("split", "user_idx", "pos") if c in samples.columns]
    rows, read = _code_reader(samples, codes, layout, key, max_lookup_cells)
    kept = [c for c in samples.columns if c not in ("history", "mask", "target", "seq_len")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = {c: batch.column(c) for c in kept}
                columns.update(_token_columns(batch, *read(batch), layout, history_len))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    types = {**{c: samples.schema[c].dataType.simpleString() for c in kept}, **_TOKEN_TYPES}
    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in types.items()))


def _token_columns(batch, history, goal, layout: TokenLayout, history_len: int) -> dict:
    """Columns of one batch from history codes (rows, slots, positions) and target codes."""
    n, slots, size = history.shape
    sizes, offsets = np.array(layout.vocab_sizes), np.array(layout.offsets)
    valid = history[:, :, 0] >= 0
    if (goal < 0).any() or (goal >= sizes).any() or (history[valid] < 0).any() or (history[valid] >= sizes).any():
        raise ValueError("a sample uses an item without a code, or a code that does not fit the layout")
    width, step = layout.max_seq_len(slots), size + 1
    used = valid.sum(axis=1)
    # Valid slots first, in order: the place of each kept item in its token row.
    row, slot = np.nonzero(valid)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
    item_at = (1 + rank * step)[:, None] + np.arange(step)
    goal_at = (1 + used * step)[:, None] + np.arange(step)
    every = np.arange(n)[:, None]

    def place(fill, head, item, goal_values):
        out = np.full((n, width), fill, np.int32)
        out[:, 0] = head
        out[row[:, None], item_at] = item
        out[every, goal_at] = goal_values
        return as_lists(out)

    def beside(values, last):
        return np.concatenate([values, np.full((len(values), 1), last, np.int32)], axis=1)

    books = np.arange(size, dtype=np.int32)[None, :]
    length = used * step + step + 1
    codes = pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * slots), as_lists(history.reshape(n * slots, size).astype(np.int32))
    )
    return {
        "input_ids": place(
            layout.pad, layout.cls, beside(history[row, slot] + offsets, layout.sep),
            beside(np.full((n, size), layout.mask), layout.eos),
        ),
        "attention_mask": as_lists(np.arange(width)[None, :] < length[:, None]),
        "labels": place(IGNORE, IGNORE, IGNORE, beside(goal + offsets, IGNORE)),
        "token_slot_ids": place(
            FILL, FILL, slot[:, None], beside(np.full((n, size), history_len), FILL)
        ),
        "token_codebook_ids": place(
            FILL, FILL, beside(np.repeat(books, len(row), 0), FILL), beside(np.repeat(books, n, 0), FILL)
        ),
        "seq_lengths": pa.array(length.astype(np.int32)),
        "history_item_ids": batch.column("history"),
        "history_mask": batch.column("mask"),
        "target_item_ids": batch.column("target"),
        "history_semantic_ids": codes,
        "target_semantic_ids": as_lists(goal.astype(np.int32)),
    }


def target_positions(tokenized: DataFrame, code_len: int) -> DataFrame:
    """Add ``target_positions``: places with a label, by code position; fails if not complete."""
    places = F.filter(
        F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.get("labels", i) != IGNORE
    )
    ordered = F.array_sort(
        F.transform(places, lambda i: F.struct(F.get("token_codebook_ids", i).alias("c"), i.alias("i")))
    )
    staged = tokenized.withColumn("_p", ordered)
    complete = F.col("_p.c") == F.array(*[F.lit(i) for i in range(code_len)])
    return staged.withColumn(
        "target_positions",
        F.when(complete, F.col("_p.i")).otherwise(
            F.raise_error(F.lit("a sample does not mask every code position once")).cast("array<int>")
        ),
    ).drop("_p")


# ---------------------------------------------------------------- prefixes and decoding


def prefix_table(codes: DataFrame) -> DataFrame:
    """(prefix, next_values, is_code) for every prefix of every code, the empty one included."""
    distinct = codes.select("code").distinct()
    cuts = F.transform(
        F.sequence(F.lit(0), F.size("code")),
        lambda n: F.struct(
            F.slice("code", 1, n).alias("prefix"),
            F.get("code", n).alias("next"),
            (n == F.size("code")).alias("ends"),
        ),
    )
    return distinct.select(F.inline(cuts)).groupBy("prefix").agg(
        F.sort_array(F.collect_set("next")).alias("next_values"), F.bool_or("ends").alias("is_code")
    )


def allowed_next(wanted: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``next_values`` for each ``prefix``; empty when the prefix is unknown."""
    return wanted.join(prefixes.select("prefix", "next_values"), "prefix", "left").withColumn(
        "next_values", F.coalesce("next_values", F.array().cast("array<int>"))
    )


def known_prefixes(wanted: DataFrame, prefixes: DataFrame) -> DataFrame:
    return wanted.join(prefixes, "prefix", "left_semi")


def known_codes(wanted: DataFrame, prefixes: DataFrame) -> DataFrame:
    return wanted.join(prefixes.filter("is_code"), "prefix", "left_semi")


def constrain_logits(logits: DataFrame, layout: TokenLayout, allowed: str | None = None) -> DataFrame:
    """Block tokens outside the range of their code position in (codebook, token, logit) rows.

    ``allowed``: optional column with an array of token ids; null or empty means no limit.
    """
    starts = F.array(*[F.lit(v) for v in layout.offsets])[F.col("codebook")]
    sizes = F.array(*[F.lit(v) for v in layout.vocab_sizes])[F.col("codebook")]
    ok = (F.col("token") >= starts) & (F.col("token") < starts + sizes)
    if allowed:
        unlimited = F.coalesce(F.size(allowed), F.lit(0)) <= 0
        ok = ok & (unlimited | F.array_contains(F.col(allowed), F.col("token")))
    return logits.withColumn("logit", F.when(ok, F.col("logit")).otherwise(F.lit(BLOCKED_LOGIT)))


@dataclass(frozen=True)
class _Trie:
    """Prefixes by length: entry e of a level is the prefix of its parent and its value, and a parent on the next level.

    ``first`` holds where each parent's entries begin; they ascend by value.
    """

    values: list[np.ndarray]
    first: list[np.ndarray]

    @staticmethod
    def of(prefixes: DataFrame, steps: int) -> "_Trie | None":
        """None where the table is no tree: a prefix twice, or one that its own prefix does not lead to."""
        table = prefixes.filter(F.col("prefix").isNotNull() & (F.size("prefix") < steps)).select("prefix", "next_values").toArrow()
        length = pc.list_value_length(table["prefix"])
        values, first, parents = [], [], 1
        for level in range(steps):
            rows = table.filter(pc.equal(length, level))
            prefix = as_matrix(rows["prefix"], np.int64).reshape(rows.num_rows, level)
            node = np.zeros(rows.num_rows, np.int64)
            for c in range(level):
                node = _entries(values[c], first[c], node, prefix[:, c])
            if (node < 0).any() or len(np.unique(node)) < len(node):
                return None
            nexts = rows["next_values"].combine_chunks()
            sizes = nexts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = nexts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            parent = np.repeat(node, sizes)
            order = np.lexsort((value, parent))
            values.append(value[order])
            first.append(np.searchsorted(parent[order], np.arange(parents + 1)))
            parents = len(value)
        return _Trie(values, first)


def _entries(values: np.ndarray, first: np.ndarray, node: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The entries of values below their nodes; -1 where there is none."""
    if len(values) == 0:
        return np.full(len(node), -1)
    low, span = min(values.min(), value.min(initial=0)), max(values.max(), value.max(initial=0)) + 1
    span -= low
    keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * span + values - low
    wanted = node * span + value - low
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((node >= 0) & (keys[at] == wanted), at, -1)


def _order_keys(logits: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """Integers in the order in which Spark sorts doubles: nulls, numbers, NaN."""
    bits = (logits + 0.0).view(np.int64)  # one zero only
    keys = np.where(bits < 0, bits ^ np.int64(np.iinfo(np.int64).max), bits)
    keys = np.where(np.isnan(logits), np.iinfo(np.int64).max, keys)
    return keys if valid is None else np.where(valid, keys, np.iinfo(np.int64).min)


def _decoded(column: pa.Array, layout: TokenLayout, trie: _Trie | None) -> np.ndarray:
    logits, first, rows = flat_lists(column)
    inner = column.flatten().flatten()
    valid = inner.is_valid().to_numpy(zero_copy_only=False) if inner.null_count else None
    n, steps = len(column), layout.code_len
    given = np.diff(rows)
    if ((given > 0) & (given < steps)).any():
        raise ValueError("a sample has no logits for some of its code positions")
    out, node = np.zeros((n, steps), np.int32), np.zeros(n, np.int64)
    for step, (offset, size) in enumerate(zip(layout.offsets, layout.vocab_sizes)):
        values, start, every = np.arange(size), np.array([0, size]), 0
        if trie is not None:  # the last node stands for all that restrict nothing
            start = np.append(trie.first[step], len(trie.values[step]) + size)
            values, every = np.append(trie.values[step], values), len(start) - 2
        own = np.where(node >= 0, node, every) if trie is not None else np.zeros(n, np.int64)
        own = np.where(np.diff(start)[own] > 0, own, every)
        counts = np.diff(start)[own]
        row = np.repeat(np.arange(n), counts)
        ends = np.cumsum(counts)
        at = np.repeat(start[own], counts) + np.arange(len(row)) - np.repeat(ends - counts, counts)
        list_no = np.minimum(rows[:-1] + step, max(len(first) - 2, 0))
        begin, length = (first[list_no], np.where(given > 0, np.diff(first)[list_no], 0)) if len(first) > 1 else (np.zeros(n, np.int64), np.zeros(n, np.int64))
        place = values[at] + offset
        there = (place >= 0) & (place < length[row])
        key = np.full(len(row), np.iinfo(np.int64).min)
        wanted = begin[row[there]] + place[there]
        key[there] = _order_keys(logits[wanted], None if valid is None else valid[wanted])
        top = np.flatnonzero(key == np.maximum.reduceat(key, ends - counts)[row])
        best = top[np.concatenate([[True], row[top][1:] != row[top][:-1]])]  # the lowest value wins ties
        out[:, step] = values[at[best]]
        node = np.where(own == every, -1, at[best]) if trie is not None else node
    return out


def _decode_in_batches(samples: DataFrame, layout: TokenLayout, trie: _Trie | None) -> DataFrame:
    shared = samples.sparkSession.sparkContext.broadcast(trie)
    most = max([*layout.vocab_sizes, *(int(np.diff(f).max(initial=0)) for f in (trie.first if trie is not None else []))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, _OPTIONS // most)):
                part = batch.slice(lo, max(1, _OPTIONS // most))
                code = as_lists(_decoded(part.column("logits"), layout, shared.value))
                yield pa.RecordBatch.from_arrays([*part.columns, code], [*part.schema.names, "code"])

    typed = samples.withColumn("logits", F.col("logits").cast("array<array<double>>"))
    return typed.mapInArrow(run, typed.withColumn("code", F.array().cast("array<int>")).schema)


def greedy_decode(
    samples: DataFrame,
    layout: TokenLayout,
    prefixes: DataFrame | None = None,
    scorer: Callable[[DataFrame, int], DataFrame] | None = None,
    max_trie_entries: int = MAX_TRIE_ENTRIES,
) -> DataFrame:
    """Add ``code``: at every step the best value of its range that continues a known prefix.

    Without ``scorer`` the column ``logits`` holds one array over the whole vocabulary per
    step. ``scorer(state, step)`` may instead add ``step_logits`` from the values chosen so
    far (column ``prefix``). A prefix without known continuation is not restricted; the lowest
    value wins ties.

    Given logits are decoded a batch at a time; a prefix table of a checked size travels with the tasks as a
    tree and no sample moves. Larger tables and scorers take one join a step.
    """
    if scorer is None:
        if prefixes is None:
            return _decode_in_batches(samples, layout, None)
        entries = prefixes.agg(F.coalesce(F.sum(F.greatest(F.size("next_values"), F.lit(0)) + F.size("prefix")), F.lit(0))).first()[0]
        trie = _Trie.of(prefixes, layout.code_len) if entries <= max_trie_entries else None
        if trie is not None:
            return _decode_in_batches(samples, layout, trie)
    state = samples.withColumn("prefix", F.array().cast("array<int>"))
    kept = [*samples.columns, "prefix"]
    for step, (offset, size) in enumerate(zip(layout.offsets, layout.vocab_sizes)):
        if scorer is None:
            scored = state.withColumn("step_logits", F.col("logits")[step])
        else:
            scored = scorer(state, step)
        everything = F.sequence(F.lit(0), F.lit(size - 1))
        if prefixes is None:
            options = scored.withColumn("_values", everything)
        else:
            joined = allowed_next(scored, prefixes)
            options = joined.withColumn(
                "_values", F.when(F.size("next_values") > 0, F.col("next_values")).otherwise(everything)
            )
        best = F.array_max(
            F.transform(
                "_values",
                lambda v: F.struct(F.get("step_logits", v + offset).alias("logit"), (-v).alias("neg")),
            )
        )
        state = options.withColumn("prefix", F.concat("prefix", F.array(-best["neg"]))).select(*kept)
    return state.withColumnRenamed("prefix", "code")
