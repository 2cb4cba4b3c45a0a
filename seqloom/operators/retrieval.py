"""Full-catalogue scoring, ranking and retrieval metrics.

Neither queries nor items are shuffled. The catalogue is cut into blocks of checked size; each block
in turn is sent to the executors, which score their queries against it where they are and carry a
running state per query: the number of better items, the best ones so far, and the log-sum of scores.
Scores in single precision tell most items apart; those closer to the target's than their error
are scored again in double precision, so ranks and best items are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.operators.checks import parse_topk
from seqloom.operators.gather import as_matrix
from seqloom.operators.popularity import group_names
from seqloom.session import materialize

ITEM_BLOCK_BYTES = 256 << 20  # of item vectors sent at once
_CELLS = 1 << 17  # scores held at once inside a task: few enough for a core's own cache
_TILE = 256  # items met at once
_PAIRS = 1 << 14  # pairs scored exactly at once


def _dot_scores(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return queries @ items.T


def _neg_sq_l2(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return 2.0 * (queries @ items.T) - (queries**2).sum(1)[:, None] - (items**2).sum(1)[None, :]


def _dot_rows(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return (queries * items).sum(axis=1)


def _neg_sq_l2_rows(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return 2.0 * (queries * items).sum(axis=1) - (queries**2).sum(axis=1) - (items**2).sum(axis=1)


def _code_rows(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return np.take_along_axis(queries, items.astype(np.int64), axis=1).sum(axis=1)


def _product_size(queries: np.ndarray, items: float) -> np.ndarray:
    return queries * items


def _distance_size(queries: np.ndarray, items: float) -> np.ndarray:
    return (queries + items) ** 2


# Scores of every query with every item (codes are scored by their tree), and of query i with item i.
SCORES: dict[str, tuple[Callable | None, Callable]] = {
    "dot": (_dot_scores, _dot_rows),
    "neg_l2": (_neg_sq_l2, _neg_sq_l2_rows),
    "code": (None, _code_rows),
}
# What the terms of a score add up to at most, by the lengths of a query and of the longest item.
_SIZES = {"dot": _product_size, "neg_l2": _distance_size}
_TOP = "array<struct<score:double,item_idx:int>>"


@dataclass(frozen=True)
class _Rules:
    score: str
    k: int
    penalty_weight: float
    temperature: float | None
    decimals: int | None
    key: tuple[str, ...]

    def rounded(self, scores: np.ndarray) -> np.ndarray:
        return scores if self.decimals is None else np.round(scores, self.decimals)

    def margin(self, scores: np.ndarray) -> np.ndarray:
        """Scores further apart than this keep their order when they are rounded."""
        size = np.where(np.isfinite(scores), np.abs(scores), 0.0)
        return np.zeros_like(size) if self.decimals is None else 10.0**-self.decimals + 1e-15 * size


@dataclass(frozen=True)
class _Block:
    """Items in ascending order."""

    index: np.ndarray
    vecs: np.ndarray
    penalties: np.ndarray

    @staticmethod
    def of(items: DataFrame) -> "_Block":
        rows = items.toArrow().sort_by("item_idx")
        kind = np.float32 if items.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
        return _Block(rows["item_idx"].to_numpy().astype(np.int64), as_matrix(rows["vec"], kind), rows["penalty"].to_numpy())

    @cached_property
    def single(self) -> np.ndarray:
        """The vectors in single precision."""
        with np.errstate(over="ignore"):
            return self.vecs.astype(np.float32, copy=False)

    @cached_property
    def longest(self) -> float:
        return max((float(np.linalg.norm(self.vecs[i : i + _PAIRS].astype(np.float64), axis=1).max()) for i in range(0, len(self.vecs), _PAIRS)), default=0.0)

    def tree(self, rules: _Rules) -> "_CodeTree":
        if "_tree" not in self.__dict__:
            self.__dict__["_tree"] = _CodeTree.of(self, rules)
        return self.__dict__["_tree"]

    def places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where items are in this block, and which of them are."""
        if len(self.index) == 0:
            return np.zeros(len(items), np.int64), np.zeros(len(items), bool)
        at = np.minimum(np.searchsorted(self.index, items), len(self.index) - 1)
        return at, self.index[at] == items


def rank_catalogue(
    queries: DataFrame,
    items: DataFrame,
    key: list[str],
    k: int = 20,
    score: str = "dot",
    exclude_history: bool = True,
    penalty_weight: float = 0.0,
    temperature: float | None = None,
    decimals: int | None = 10,
    block_bytes: int = ITEM_BLOCK_BYTES,
) -> DataFrame:
    """Rank every catalogue item for every query.

    ``queries``: ``key`` columns, ``vec``, ``target``, and ``history``/``mask`` when histories are
    excluded. ``items``: ``item_idx``, ``vec`` and, with a penalty weight, ``penalty``.

    Returns key, target, ``target_score``, ``rank`` = 1 + number of better items (ties favour
    the target), ``top`` = best ``k`` as (score, item_idx), ties by item index (with ``k`` = 0 none
    are looked for and it is empty; the rank is over the whole catalogue all the same), and with a
    ``temperature`` also ``log_sum_exp`` of the unpenalised scores / temperature over all
    items. Excluded history items take no part; the target always does; a target that is not
    in ``items`` raises an error. A null target has a null score and rank.
    Scores are rounded to ``decimals`` so that equal vectors tie in every block.
    """
    spark = queries.sparkSession
    rules = _Rules(score, k, penalty_weight, temperature, decimals, tuple(key))
    penalty = F.col("penalty").cast("double") if penalty_weight != 0.0 else F.lit(0.0)
    vec = F.col("vec").cast("array<float>" if items.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>")
    table = items.select("item_idx", vec.alias("vec"), penalty.alias("penalty"))
    each = 4 if table.schema["vec"].dataType.simpleString() == "array<float>" else 8
    size = table.agg(F.coalesce(F.sum(F.size("vec") * each + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    history = (
        F.transform(F.arrays_zip("history", "mask"), lambda e: F.when(e["mask"], e["history"]).otherwise(-1))
        if exclude_history
        else F.array().cast("array<int>")
    )
    state = queries.select(
        *key, F.col("target").cast("int").alias("target"), F.col("vec").cast("array<double>").alias("vec"), history.alias("seen"),
        F.lit(None).cast("double").alias("target_score"), F.lit(0).cast("bigint").alias("better"),
        F.array().cast(_TOP).alias("top"), F.lit(float("-inf")).alias("lse"),
    )

    def passed(rows: DataFrame, block: DataFrame, step: Callable, names: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(_Block.of(block))

        def run(batches):
            for batch in batches:
                yield step(batch, shared.value, rules).select(names)

        return rows.mapInArrow(run, rows.select(*names).schema)

    if blocks == 1:
        told = [name for name in state.columns if name not in ("vec", "seen")]  # no later block asks for these
        state = passed(state, table, lambda rows, block, r: _rank_rows(_score_targets(rows, block, r), block, r), told)
    else:
        table = materialize(table.withColumn("_block", F.pmod(F.xxhash64("item_idx"), F.lit(blocks)).cast("int")), "item-blocks", ["_block"])
        # A query's own score must be known before better ones are counted, so the blocks come twice.
        for step in (_score_targets, _rank_rows):
            for b in range(blocks):
                state = materialize(passed(state, table.filter(F.col("_block") == b), step, state.columns), "ranking")
    known = F.col("target").isNotNull() & F.col("target_score").isNull()
    told = F.when(known, F.raise_error(F.lit("a target is not in the items")).cast("double")).otherwise(F.col("target_score"))
    rank = F.when(F.col("target").isNotNull(), F.col("better") + 1)
    out = state.select(*key, "target", told.alias("target_score"), rank.alias("rank"), "top", F.col("lse").alias("log_sum_exp"))
    return out if temperature is not None else out.drop("log_sum_exp")


def _with_column(rows: pa.RecordBatch, **columns) -> pa.RecordBatch:
    arrays = [columns.get(name, rows.column(name)) for name in rows.schema.names]
    return pa.RecordBatch.from_arrays(arrays, rows.schema.names)


def _targets(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("target").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _score_targets(rows: pa.RecordBatch, block: _Block, rules: _Rules) -> pa.RecordBatch:
    """Fill in the scores of the targets that this block holds."""
    place, here = block.places(_targets(rows))
    known = rows.column("target_score").is_valid().to_numpy(zero_copy_only=False)
    own = rows.column("target_score").fill_null(0.0).to_numpy(zero_copy_only=False).copy()
    if here.any():
        at = place[here]
        own[here] = _exact(as_matrix(rows.column("vec"))[here], at, block, rules)
    return _with_column(rows, target_score=pa.array(own, mask=~(known | here)))


def _exact(queries: np.ndarray, at: np.ndarray, block: _Block, rules: _Rules) -> np.ndarray:
    """Rounded scores of query i with the item at place ``at[i]``."""
    raw = SCORES[rules.score][1](queries, block.vecs[at].astype(np.float64))
    return rules.rounded(raw - rules.penalty_weight * block.penalties[at])


def _packed(mask: np.ndarray) -> np.ndarray:
    """Eight cells a byte; every row begins with a byte of its own."""
    if mask.shape[1] % 8:
        return np.packbits(mask, axis=1)
    return np.packbits(mask.reshape(-1)).reshape(len(mask), -1)


def _bits(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells."""
    flat = packed.reshape(-1)
    if flat.size % 8:
        byte = np.flatnonzero(flat)
    else:
        word, part = np.nonzero(flat.reshape(-1, 8)[words := np.flatnonzero(flat.view(np.uint64))])
        byte = words[word] * 8 + part
    at, bit = np.nonzero(np.unpackbits(flat[byte][:, None], axis=1))
    return byte[at] // packed.shape[1], byte[at] % packed.shape[1] * 8 + bit


def _row_counts(packed: np.ndarray) -> np.ndarray:
    if packed.shape[1] % 8:
        return np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    return np.bitwise_count(packed.view(np.uint64)).sum(axis=1, dtype=np.int64)


def _places_in_rows(row: np.ndarray, n: int) -> np.ndarray:
    """Place of each entry among those of its row; rows ascend."""
    return np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]


class _Best:
    """Entries (row, item, nearly its score) that may be among their row's ``k`` best.

    ``floor`` is the k-th best score so far and ``slack`` how far a score may be off: an item whose score is
    more than two slacks below the floor is not among the best.
    """

    def __init__(self, k: int, floor: np.ndarray, slack: np.ndarray):
        self.k, self.floor, self.slack, self.parts, self.held = k, floor.copy(), slack, [], 0

    @property
    def limit(self) -> np.ndarray:
        return self.floor - 2 * self.slack

    def raise_floor(self, scores: np.ndarray) -> None:
        """From a row's scores of a first tile."""
        if self.k <= scores.shape[1]:
            at = scores.shape[1] - self.k
            self.floor = np.fmax(self.floor, np.partition(scores, at, axis=1)[:, at])

    def add(self, row: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        kept = np.isfinite(score)
        self.parts.append((row[kept], at[kept], score[kept].astype(np.float64)))
        self.held += len(self.parts[-1][0])
        if self.held > 6 * self.k * len(self.floor) + 1024:
            self.tighten()

    def tighten(self) -> tuple[np.ndarray, np.ndarray]:
        """Raise the floors by all entries, drop those below, and return the places of the others."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(self.floor)
        row, at, score = (np.concatenate(parts) for parts in zip(*self.parts))
        order = np.argsort(row.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
        row, at, score = row[order], at[order], score[order]
        most = int(np.bincount(row, minlength=n).max(initial=0))
        if most >= self.k:
            table = np.full((n, most), -np.inf)
            table[row, _places_in_rows(row, n)] = score
            self.floor = np.fmax(self.floor, np.partition(table, most - self.k, axis=1)[:, most - self.k])
        kept = score >= self.limit[row]
        self.parts, self.held = [(row[kept], at[kept], score[kept])], int(kept.sum())
        return row[kept], at[kept]


@dataclass
class _Part:
    """Some queries: their vectors, own scores, best scores held (-inf where fewer than k), log-sums, and what is left out of their scores."""

    queries: np.ndarray
    own: np.ndarray
    floor: np.ndarray
    lse: np.ndarray
    out_row: np.ndarray
    out_at: np.ndarray

    def by_place(self) -> None:
        order = np.argsort(self.out_at, kind="stable")
        self.out_row, self.out_at = self.out_row[order], self.out_at[order]


def _scan_vectors(part: _Part, block: _Block, rules: _Rules):
    """Better items, log-sums and (row, place) of possible best items of some queries.

    Single precision tells most scores apart from the own one, as its error is bounded; pairs closer than the
    bound are scored again exactly. Log-sums take double precision throughout.
    """
    scores_of = SCORES[rules.score][0]
    n, width = len(part.queries), len(block.index)
    lengths = np.linalg.norm(part.queries, axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        size = _SIZES[rules.score](lengths, block.longest) + rules.penalty_weight * np.abs(block.penalties).max()
    single = rules.temperature is None and bool((np.maximum(size, lengths) < 1e30).all()) and block.longest < 1e30
    unit = 2.0**-24 if single else 2.0**-53
    error = (part.queries.shape[1] + 8) * 1.1 * unit * size + (1e-36 * (1 + lengths + block.longest) if single else 0.0)
    slack = np.where(np.isfinite(error), error, 0.0) + 4 * unit * np.where(np.isfinite(part.own), np.abs(part.own), 0.0) + rules.margin(part.own)
    kind = np.float32 if single else np.float64
    queries, table = part.queries.astype(kind, copy=False), block.single if single else block.vecs
    high, low = ((part.own + sign * slack).astype(kind)[:, None] for sign in (1, -1))
    count, best = np.zeros(n, np.int64), _Best(rules.k, part.floor, np.where(np.isfinite(error), error, 0.0) + rules.margin(size))
    warm, total = max(rules.temperature or 0.0, 1e-6), np.zeros(n)
    plain = bool((size / warm < 300).all())  # no exp can overflow
    lse = part.lse.copy()
    part.by_place()
    tile = max(_TILE, -(-4 * rules.k // 8) * 8)
    bounds = np.searchsorted(part.out_at, np.arange(0, width + tile, tile))
    open_, waiting = [], 0

    def settle() -> None:
        row, at = (np.concatenate(parts) for parts in zip(*open_))
        for i in range(0, len(row), _PAIRS):
            r = row[i : i + _PAIRS]
            count[:] += np.bincount(r[_exact(part.queries[r], at[i : i + _PAIRS], block, rules) > part.own[r]], minlength=n)
        open_.clear()

    for b, start in enumerate(range(0, width, tile)):
        items = table[start : start + tile].astype(kind, copy=False)
        penalty = rules.penalty_weight * block.penalties[start : start + tile]
        scores = scores_of(queries, items)
        bare = scores.copy() if rules.temperature is not None and rules.penalty_weight != 0.0 else scores
        if rules.penalty_weight != 0.0:
            scores -= penalty.astype(kind)
        out = slice(bounds[b], bounds[b + 1])
        left_out = part.out_row[out], part.out_at[out] - start
        hidden = scores[left_out]
        scores[left_out] = -np.inf
        above, near = _packed(scores > high), _packed(scores > low)
        count += _row_counts(above)
        row, at = _bits(above ^ near)
        if len(row) > scores.size // 32:  # many equal scores: all of these queries' again, at once
            rows = np.unique(row)
            again = rules.rounded(scores_of(part.queries[rows], block.vecs[start : start + tile].astype(np.float64)) - penalty)
            count += np.bincount(row[again[np.searchsorted(rows, row), at] > part.own[row]], minlength=n)
        elif len(row):
            open_.append((row, start + at))
            waiting += len(row)
            if waiting > 4 * _PAIRS:
                settle()
                waiting = 0
        if rules.k:
            if b == 0:
                best.raise_floor(scores)
            row, at = _bits(_packed(scores >= best.limit.astype(kind)[:, None]))
            best.add(row, start + at, scores[row, at])
        if rules.temperature is not None:
            if bare is scores:
                scores[left_out] = hidden
            bare /= warm
            if plain:
                total += np.exp(bare, out=bare).sum(axis=1)
            else:
                top = np.maximum(bare.max(axis=1), lse)
                bare -= top[:, None]
                lse = top + np.log(np.exp(bare, out=bare).sum(axis=1) + np.exp(lse - top))
    if open_:
        settle()
    if rules.temperature is not None and plain:
        lse = np.logaddexp(lse, np.log(total))
    return count, lse, best.tighten()


@dataclass(frozen=True)
class _CodeTree:
    """The distinct codes in order, their prefixes as a tree, and the items of every code.

    A prefix is scored once for all codes that begin with it, and a code once for all its items.
    """

    values: list[np.ndarray]  # of every level: the place in the query vector that its nodes add
    parents: list[np.ndarray]  # of every level: the node of the level above
    penalty: np.ndarray
    items: np.ndarray  # places in the block, by code
    first: np.ndarray  # where each code's items begin

    @staticmethod
    def of(block: _Block, rules: _Rules) -> "_CodeTree":
        penalty = rules.penalty_weight * block.penalties
        rows = np.column_stack([block.vecs.astype(np.float64), penalty])
        codes, code_of, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        code_of = code_of.reshape(-1)
        values, parents, above = [], [], np.zeros(len(codes), np.int64)
        length = block.vecs.shape[1]
        for level in range(length):
            ends = codes.shape[1] if level == length - 1 else level + 1
            new = np.concatenate([[True], (codes[1:, :ends] != codes[:-1, :ends]).any(axis=1)])
            first = np.flatnonzero(new)
            values.append(codes[first, level].astype(np.int64))
            parents.append(above[first])
            above = np.cumsum(new) - 1
        return _CodeTree(values, parents, codes[:, -1], np.argsort(code_of, kind="stable"), np.concatenate([[0], np.cumsum(sizes)]))

    def scores(self, places: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of the codes from ``start`` to ``end``, with the queries in columns; ``places``: log-probabilities in rows."""
        spans = [(start, end)]
        for parent in reversed(self.parents[1:]):
            lo, hi = spans[0]
            spans.insert(0, (int(parent[lo]), int(parent[hi - 1]) + 1))
        total = None
        for level, (lo, hi) in enumerate(spans):
            own = places.take(self.values[level][lo:hi], axis=0)
            if total is not None:
                own += total.take(self.parents[level][lo:hi] - spans[level - 1][0], axis=0)
            total = own
        if self.penalty[start:end].any():
            total -= self.penalty[start:end, None]
        return total


def _scan_codes(part: _Part, block: _Block, rules: _Rules):
    """``_scan_vectors`` for code scores, which are sums along a tree."""
    tree, n = block.tree(rules), len(part.queries)
    sizes = np.diff(tree.first)
    places = np.ascontiguousarray(part.queries.T)
    margin = rules.margin(part.own)
    high, low = part.own + margin, part.own - margin
    count, lse = np.zeros(n, np.int64), part.lse.copy()
    # Of the best codes a few may have no item left: with as many more codes as items are left out, k items remain.
    pairs = np.unique(part.out_row * len(block.index) + part.out_at)
    left_out = pairs // len(block.index), pairs % len(block.index)
    most = rules.k + int(np.bincount(left_out[0], minlength=n).max(initial=0))
    best = _Best(most, np.full(n, -np.inf), margin)
    tile = max(_TILE, most)
    for start in range(0, len(sizes), tile):
        end = min(start + tile, len(sizes))
        scores, weight = tree.scores(places, start, end), sizes[start:end]
        if rules.temperature is not None:
            scaled = (scores + tree.penalty[start:end, None]) / max(rules.temperature, 1e-6)
            top = np.maximum(scaled.max(axis=0), lse)
            with np.errstate(invalid="ignore"):
                scaled -= top
                lse = top + np.log(weight @ np.exp(scaled, out=scaled) + np.exp(lse - top))
        above, near = scores > high, scores > low
        if weight.max() == 1:
            count += above.sum(axis=0) if end - start > 255 else np.add.reduce(above.view(np.uint8), axis=0, dtype=np.uint8)
        else:
            count += (weight.astype(np.float64) @ above).astype(np.int64)
        code, row = _bits(_packed(near ^ above))
        better = rules.rounded(scores[code, row]) > part.own[row]
        count += np.bincount(row, better * weight[code], n).astype(np.int64)
        if rules.k:
            if start == 0:
                best.raise_floor(scores.T)
            code, row = _bits(_packed(scores >= best.limit))
            best.add(row, start + code, scores[code, row])
    for i in range(0, len(pairs), _PAIRS):  # items left out that were counted with their codes
        row, at = (x[i : i + _PAIRS] for x in left_out)
        count -= np.bincount(row[_exact(part.queries[row], at, block, rules) > part.own[row]], minlength=n)
    if not rules.k:
        return count, lse, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    row, code = best.tighten()
    taken = np.minimum(sizes[code], most)  # of equal scores the lowest items come first
    begins = np.repeat(tree.first[code], taken) + np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
    row, at = np.repeat(row, taken), tree.items[begins]
    if len(pairs):
        key = row * len(block.index) + at
        kept = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] != key
        row, at = row[kept], at[kept]
    return count, lse, (row, at)


def _rank_rows(rows: pa.RecordBatch, block: _Block, rules: _Rules) -> pa.RecordBatch:
    """Add this block to the running state of every query, some queries at a time."""
    n, index = rows.num_rows, block.index
    if n == 0 or len(index) == 0:
        return rows
    queries = as_matrix(rows.column("vec"))
    lse = rows.column("lse").to_numpy().copy()
    better = rows.column("better").to_numpy().copy()
    own = rows.column("target_score").fill_null(np.inf).to_numpy(zero_copy_only=False)
    target_at, target_here = block.places(_targets(rows))
    seen = rows.column("seen")
    flat = seen.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    seen_row = np.repeat(np.arange(n), np.diff(seen.offsets.to_numpy()))
    seen_at, hit = block.places(flat)
    hit &= flat >= 0
    # The target is no item better than itself; among the best items it stands with its own score.
    goals = np.flatnonzero(target_here)
    out_row, out_at = np.concatenate([seen_row[hit], goals]), np.concatenate([seen_at[hit], target_at[goals]])
    order = np.argsort(out_row, kind="stable")
    out_row, out_at = out_row[order], out_at[order]

    before = rows.column("top")
    held, offsets = before.flatten(), before.offsets.to_numpy() - before.offsets[0].as_py()
    values = held.field(0).to_numpy(zero_copy_only=False)
    found = [
        (np.repeat(np.arange(n), np.diff(offsets)), values, held.field(1).to_numpy(zero_copy_only=False).astype(np.int64)),
        (goals, own[goals], index[target_at[goals]]),
    ]
    floor = np.full(n, -np.inf)
    full = np.flatnonzero(np.diff(offsets) >= rules.k) if rules.k else goals[:0]
    floor[full] = values[offsets[full] + rules.k - 1]
    scan = _scan_codes if rules.score == "code" else _scan_vectors
    step = max(1, _CELLS // max(_TILE, 4 * rules.k + 8) // (1 if rules.temperature is None else 2))
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        out = slice(*np.searchsorted(out_row, [lo, hi]))
        part = _Part(queries[lo:hi], own[lo:hi], floor[lo:hi], lse[lo:hi], out_row[out] - lo, out_at[out])
        count, lse[lo:hi], (row, at) = scan(part, block, rules)
        better[lo:hi] += count
        for i in range(0, len(row), _PAIRS):
            r, a = row[i : i + _PAIRS], at[i : i + _PAIRS]
            found.append((lo + r, _exact(queries[lo + r], a, block, rules), index[a]))

    if rules.k == 0:
        return _with_column(rows, better=pa.array(better), lse=pa.array(lse))
    r, value, item = (np.concatenate(parts) for parts in zip(*found))
    order = np.lexsort((item, -value, r))
    r, value, item = r[order], value[order], item[order]
    keep = _places_in_rows(r, n) < rules.k
    r, value, item = r[keep], value[keep], item[keep]
    entries = pa.StructArray.from_arrays([pa.array(value, pa.float64()), pa.array(item.astype(np.int32))], ["score", "item_idx"])
    offsets = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
    return _with_column(rows, better=pa.array(better), top=pa.ListArray.from_arrays(offsets, entries), lse=pa.array(lse))


def ranks_from_scores(scores: DataFrame, key: list[str], targets: DataFrame) -> DataFrame:
    """Rank of the target from a long (key, item_idx, score) table."""
    goal = scores.join(targets.withColumnRenamed("target", "item_idx"), [*key, "item_idx"]).select(
        *key, F.col("item_idx").alias("target"), F.col("score").alias("target_score")
    )
    return (
        scores.join(goal, key)
        .groupBy(*key, "target")
        .agg((F.count_if(F.col("score") > F.col("target_score")) + 1).alias("rank"))
    )


def limit_batches(samples: DataFrame, n_batches: int, batch_size: int, index: str = "sample_index") -> DataFrame:
    """The first ``n_batches`` evaluation batches; 0 means all."""
    return samples if n_batches <= 0 else samples.filter(F.col(index) < n_batches * batch_size)


def _metric_columns(ks: list[int]) -> list:
    rank = F.col("rank")
    columns = [F.count(F.lit(1)).alias("sample_count"), F.avg(rank.cast("double")).alias("mean_rank")]
    for k in ks:
        hit = rank <= k
        columns += [
            F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"hit@{k}"),
            F.avg(F.when(hit, 1.0).otherwise(0.0)).alias(f"recall@{k}"),
            F.avg(F.when(hit, 1.0 / rank).otherwise(0.0)).alias(f"mrr@{k}"),
            F.avg(F.when(hit, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"ndcg@{k}"),
        ]
    return columns


def retrieval_metrics(ranks: DataFrame, topk: str | list[int] = (5, 10, 20)) -> DataFrame:
    """One row: sample count, mean rank and hit/recall/mrr/ndcg at each k."""
    return ranks.agg(*_metric_columns(parse_topk(topk)))


def grouped_metrics(ranks: DataFrame, groups: DataFrame, topk: str | list[int] = (5, 10, 20)) -> DataFrame:
    """The same metrics overall and per popularity group of the target, in one pass.

    Groups without samples are kept with a count of 0 and null metrics.
    """
    labelled = ranks.join(groups.select(F.col("item_idx").alias("target"), "group"), "target", "left")
    found = labelled.groupingSets([[], ["group"]], "group").agg(
        F.grouping_id().alias("_level"), *_metric_columns(parse_topk(topk))
    )
    named = found.select(
        F.when(F.col("_level") > 0, "overall").otherwise(F.col("group")).alias("group"),
        *[c for c in found.columns if c not in ("group", "_level")],
    )
    spark = ranks.sparkSession
    wanted = spark.createDataFrame([("overall",)], "group string").unionByName(
        group_names(spark).select("group")
    )
    return wanted.join(named, "group", "left").na.fill(0, ["sample_count"])


def metrics_long(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(…by, metric, value) form of a metrics table."""
    values = [c for c in metrics.columns if c not in by]
    casted = metrics.select(*by, *[F.col(c).cast("double").alias(c) for c in values])
    return casted.unpivot(by, values, "metric", "value")


def predictions(
    ranked: DataFrame, samples: DataFrame, item_map: DataFrame, groups: DataFrame, key: list[str]
) -> DataFrame:
    """Nested prediction records: target, rank, history ids, retrieved items, group."""
    names = item_map.select("item_idx", "item_id")
    records = samples.select(*key, "split", "history", "mask").join(ranked, key)
    history = F.filter(
        F.transform(F.arrays_zip("history", "mask"), lambda e: F.when(e["mask"] & (e["history"] >= 0), e["history"])),
        lambda x: x.isNotNull(),
    )
    parts = records.select(
        *key,
        F.inline(
            F.concat(
                F.transform(history, lambda x, i: F.struct(F.lit("h").alias("part"), i.alias("n"), x.alias("item_idx"), F.lit(None).cast("double").alias("score"))),
                F.transform("top", lambda x, i: F.struct(F.lit("t").alias("part"), i.alias("n"), x["item_idx"].alias("item_idx"), x["score"].alias("score"))),
            )
        ),
    ).join(names.withColumnRenamed("item_id", "_name"), "item_idx", "left")
    parts = parts.withColumn("item_id", F.coalesce("_name", F.raise_error(F.lit("an item has no item id")).cast("string")))

    def listed(part: str, *fields) -> object:
        rows = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("n", *fields))))
        return rows

    lists = parts.groupBy(*key).agg(
        F.transform(listed("h", "item_id"), lambda x: x["item_id"]).alias("history_items"),
        F.transform(
            listed("t", "item_idx", "item_id", "score"),
            lambda x: F.struct((x["n"] + 1).alias("rank"), x["item_idx"].alias("item_idx"), x["item_id"].alias("item_id"), x["score"].alias("score")),
        ).alias("retrieved_topk"),
    )
    return (
        records.join(lists, key, "left")
        .join(names.select(F.col("item_idx").alias("target"), F.col("item_id").alias("_name")), "target", "left")
        .withColumn("target_item_id", F.coalesce("_name", F.raise_error(F.lit("a target has no item id")).cast("string")))
        .join(groups.select(F.col("item_idx").alias("target"), "group"), "target", "left")
        .select(
            "split",
            *key,
            F.col("target").alias("target_item_idx"),
            "target_item_id",
            F.col("rank").alias("target_rank"),
            F.coalesce("history_items", F.array().cast("array<string>")).alias("history_items"),
            F.coalesce("retrieved_topk", F.array().cast(lists.schema["retrieved_topk"].dataType)).alias("retrieved_topk"),
            "group",
        )
    )


def score_queries(samples: DataFrame, scorer: Callable, dim_column: str = "vec") -> DataFrame:
    """Add query vectors made by ``scorer(pandas frame) -> list of vectors`` per Arrow batch."""
    schema = samples.withColumn(dim_column, F.array(F.lit(0.0))).schema

    def run(frames):
        for frame in frames:
            yield frame.assign(**{dim_column: list(scorer(frame))})

    return samples.mapInPandas(run, schema)
