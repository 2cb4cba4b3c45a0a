"""Pair-wise factor training over a rotating grid of blocks, many steps at once without conflicts.

Left ids (users, center items) and right ids (items, context items) are dealt into equally many
blocks, anew in every epoch. An epoch has one round per block: in round s each left block meets the
right block s places on, so the tasks of a round share no factor row and train in parallel, in
mini-batches, on the observed pairs of their two blocks. After all rounds every pair has been
visited once for each time it was observed. Factors travel once a round, in single precision, pairs
once an epoch. The rounds of an epoch are one job whose shuffles hand factors on; they are written
only after each epoch.

Negatives come from the right block at hand. As blocks are dealt anew, any item can be a negative
of any pair; and because all of a left id's pairs with a block are in one task, a task knows which of
the block's items are no negatives for it.

A left id with more than a block's share of the observations is split up: each part meets a fixed
share of the right blocks, and the parts' factors are averaged after each epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, gcd, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.gather import as_lists, as_matrix
from seqloom.operators.sampling import gaussian
from seqloom.session import materialize, materialize_with

LEAST_BLOCKS = 4
CELL_PAIRS = 100_000  # distinct pairs of two blocks, on average: few enough for millions of pairs to keep many tasks busy
CELL_VISITS = 1_000_000  # observations of two blocks, on average
BLOCK_BYTES = 128 << 20  # of one block's factors, on average
EPOCH_BYTES = 4 << 30  # of either side's factors that travel in an epoch
_FACTORS = "kind int, id bigint, part int, vec array<float>, moved double, mass double"
_DENSE = 48  # cells that cost no more than one visit by itself
_EXACT_TRIES = 16
_BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Training:
    """``loss``: "ranking" (an observed item above a lacking one, with item biases) or "skipgram"
    (an observed context against drawn ones). Steps are scaled by the past gradients of a row."""

    loss: str
    dim: int
    epochs: int = 5
    negatives: int = 1
    rate: float = 0.1
    reg: float = 0.0
    batch: int = 256
    seed: int = 0
    blocks: int | None = None

    def __post_init__(self):
        if self.loss not in ("ranking", "skipgram"):
            raise ValueError(f"unknown loss {self.loss!r}")
        if min(self.dim, self.epochs, self.negatives, self.batch) < 1 or (self.blocks or 1) < 1:
            raise ValueError("dim, epochs, negatives, batch and blocks must be positive")

    @property
    def width(self) -> int:
        return self.dim + (self.loss == "ranking")  # the last place holds the item's bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


class _Side:
    """Factors of one block, and how far their rows have moved."""

    def __init__(self, table: pa.Table, width: int):
        self.table = table
        self.vec = as_matrix(table["vec"]).copy() if table.num_rows else np.zeros((0, width))
        self.moved = table["moved"].to_numpy().copy()

    def step(self, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        total, own = np.add.reduceat(gradient[order], first, axis=0), sorted_rows[first]
        self.step_all(own, total, rate)

    def step_all(self, own: np.ndarray, total: np.ndarray, rate: float) -> None:
        """``step`` with the gradients of distinct rows, added up already."""
        self.moved[own] += (total**2).mean(axis=1)
        self.vec[own] += rate * total / np.sqrt(self.moved[own] + 1e-10)[:, None]

    def result(self, kind: int) -> pa.Table:
        n = self.table.num_rows
        columns = [pa.array(np.full(n, kind, np.int32)), self.table["id"], self.table["part"], as_lists(self.vec), pa.array(self.moved), self.table["mass"]]
        return pa.table(columns, ["kind", "id", "part", "vec", "moved", "mass"])


class _Lacking:
    """Evenly drawn right rows that a left row has no pair with."""

    def __init__(self, left: np.ndarray, right: np.ndarray, n_right: int):
        self.n = n_right
        self.keys = np.unique(left * n_right + right)

    def _has(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def draw(self, left: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """-1 where the left row has pairs with the whole block."""
        out = rng.integers(0, self.n, len(left))
        open_ = np.flatnonzero(self._has(left, out))
        for _ in range(_EXACT_TRIES):
            if len(open_) == 0:
                return out
            out[open_] = rng.integers(0, self.n, len(open_))
            open_ = open_[self._has(left[open_], out[open_])]
        for row in np.unique(left[open_]):  # those that have most of the block: look at what is left
            lo, hi = np.searchsorted(self.keys, [row * self.n, (row + 1) * self.n])
            free = np.setdiff1d(np.arange(self.n), self.keys[lo:hi] - row * self.n)
            own = open_[left[open_] == row]
            out[own] = rng.choice(free, len(own)) if len(free) else -1
        return out


def _visits(counts: np.ndarray, batch: int, rng: np.random.Generator):
    """Row numbers in batches, each row as often as it counts, in a scattered order."""
    ends = np.cumsum(counts)
    total = int(ends[-1])
    stride = min(max(1, int(total * 0.618)), (1 << 31) - 1)
    while gcd(stride, total) != 1:
        stride -= 1
    start = int(rng.integers(0, total))
    for at in range(0, total, batch):
        place = (start + np.arange(at, min(at + batch, total), dtype=np.int64) * stride) % total
        yield np.searchsorted(ends, place, "right")


def _train_cell(t: Training, round_seed: tuple[int, ...], parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rng = np.random.default_rng([*round_seed, key[0].as_py()])
        kind = table["kind"].to_numpy()
        left = _Side(table.filter(pa.array(kind == 0)).sort_by([("id", "ascending"), ("part", "ascending")]), t.width)
        right = _Side(table.filter(pa.array(kind == 1)).sort_by("id"), t.width)
        pairs = table.filter(pa.array(kind == 2)).sort_by([("id", "ascending"), ("part", "ascending"), ("other", "ascending")])
        if pairs.num_rows:
            number = lambda rows: rows["id"].to_numpy() * parts + rows["part"].to_numpy()
            u = np.searchsorted(number(left.table), number(pairs))
            p = np.searchsorted(right.table["id"].to_numpy(), pairs["other"].to_numpy())
            step = _ranking(t, left, right, u, p, rng) if t.loss == "ranking" else _skipgram(t, left, right, u, p, rng)
            for rows in _visits(pairs["n"].to_numpy(), t.batch, rng):
                step(rows)
        return pa.concat_tables([left.result(0), right.result(1)])

    return run


def _ranking(t: Training, left: _Side, right: _Side, u_of, p_of, rng):
    lacking = _Lacking(u_of, p_of, len(right.vec))

    def step(rows: np.ndarray) -> None:
        rows = np.repeat(rows, t.negatives)
        u, p, q = u_of[rows], p_of[rows], lacking.draw(u_of[rows], rng)
        u, p, q = u[q >= 0], p[q >= 0], q[q >= 0]
        if len(u) == 0:
            return
        x, apart = left.vec[u], right.vec[p] - right.vec[q]
        pull = _sigmoid(-(x * apart).sum(axis=1))[:, None] / t.negatives
        on_left = pull * apart - t.reg * x
        on_left[:, -1] = 0.0  # the place of the bias stays 1
        on_right = np.concatenate([pull * x - t.reg * right.vec[p], -pull * x - t.reg * right.vec[q]])
        left.step(u, on_left, t.rate)
        right.step(np.concatenate([p, q]), on_right, t.rate)

    return step


def _counted(visits: int, n_left: int, n_right: int) -> bool:
    """Whether all pairs of a batch's rows cost less as one matrix product than its visits one by one."""
    return n_left * n_right <= _DENSE * visits


def _numbering(n: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function to the distinct of some ids below ``n``, and a table from an id to its place among them (for these ids)."""
    met, place = np.zeros(n, bool), np.zeros(n, np.int64)

    def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met[ids] = True
        own = np.flatnonzero(met)
        met[own] = False
        place[own] = np.arange(len(own))
        return own, place

    return numbered


def _skipgram(t: Training, left: _Side, right: _Side, u_of, p_of, rng):
    mass = np.cumsum(right.table["mass"].to_numpy())
    of_left, of_right = _numbering(len(left.vec)), _numbering(len(right.vec))

    def step(rows: np.ndarray) -> None:
        u, p = u_of[rows], p_of[rows]
        drawn = np.searchsorted(mass, rng.random((len(u), t.negatives)) * mass[-1], "right")
        others = np.concatenate([p[:, None], np.minimum(drawn, len(mass) - 1)], axis=1)
        lefts, left_at = of_left(u)
        rights, right_at = of_right(others.reshape(-1))
        if _counted(others.size, len(lefts), len(rights)):
            by_count(left_at[u], right_at[others], lefts, rights)
            return
        x, y = left.vec[u], right.vec[others]
        pull = -_sigmoid(np.einsum("bd,bkd->bk", x, y))
        pull[:, 0] += 1.0
        on_right = pull[:, :, None] * x[:, None, :]
        left.step(u, np.einsum("bk,bkd->bd", pull, y) - t.reg * x, t.rate)
        right.step(others.reshape(-1), on_right.reshape(-1, x.shape[1]) - t.reg * y.reshape(-1, x.shape[1]), t.rate)

    def by_count(u: np.ndarray, others: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> None:
        """The same step, each pair of rows weighing its visits."""
        shape = len(lefts), len(rights)
        cell = u[:, None] * shape[1] + others
        observed = np.bincount(cell[:, 0], minlength=shape[0] * shape[1]).reshape(shape)
        visits = np.bincount(cell.reshape(-1), minlength=shape[0] * shape[1]).reshape(shape)
        x, y = left.vec[lefts], right.vec[rights]
        pull = observed - visits * _sigmoid(x @ y.T)
        left.step_all(lefts, pull @ y - t.reg * observed.sum(axis=1)[:, None] * x, t.rate)
        right.step_all(rights, pull.T @ x - t.reg * visits.sum(axis=0)[:, None] * y, t.rate)

    return step


def _block(seed: tuple[int, ...], blocks: int, *ids: str) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(s) for s in seed], *ids), F.lit(blocks)).cast("int")


def _initial(ids: DataFrame, kind: int, t: Training, zero: bool) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(t.dim - 1))
    drawn = F.transform(places, lambda d: F.lit(0.0) if zero else gaussian(t.seed + kind, F.col("id"), d) * 0.02)
    if t.loss == "ranking":
        drawn = F.concat(drawn, F.array(F.lit(1.0 - kind)))
    return ids.select(F.lit(kind).alias("kind"), "id", "part", drawn.cast("array<float>").alias("vec"), F.lit(0.0).alias("moved"), "mass")


def _averaged(lefts: DataFrame, heavy: DataFrame) -> DataFrame:
    """Parts of a split id start the next epoch from their common mean."""
    split = lefts.join(F.broadcast(heavy.select("id")), "id", "left_semi")
    means = split.groupBy("id").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).cast("array<float>").alias("vec"), F.avg("moved").alias("moved")
    )
    again = split.drop("vec", "moved").join(means, "id").select("kind", "id", "part", "vec", "moved", "mass")
    return lefts.join(F.broadcast(heavy.select("id")), "id", "left_anti").select("kind", "id", "part", "vec", "moved", "mass").unionByName(again)


def _block_count(t: Training, pairs: int, largest: int, observed: int = 0) -> int:
    """Blocks of either side, which is also how many tasks train at once and how often factors travel in an epoch."""
    wanted = max(ceil(sqrt(pairs / CELL_PAIRS)), ceil(sqrt(observed / CELL_VISITS)))
    affordable = EPOCH_BYTES // max(1, largest * t.width * 4)
    return t.blocks or max(LEAST_BLOCKS, min(wanted, affordable), ceil(largest * t.width * 8 / BLOCK_BYTES))


def _round(rows: DataFrame, blocks: int, train: Callable[[tuple, pa.Table], pa.Table]) -> DataFrame:
    """The factors after one round; ``rows`` hold the cells they belong to, one task a cell."""

    def run(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        for cell in pc.unique(table["cell"]):
            out = train((cell,), table.filter(pc.equal(table["cell"], cell)).drop_columns("cell"))
            vec = out.schema.get_field_index("vec")
            yield from out.set_column(vec, "vec", out["vec"].cast(pa.list_(pa.float32()))).to_batches(_BATCH_ROWS)

    return rows.repartitionById(blocks, "cell").mapInArrow(run, _FACTORS)


def train_factors(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, t: Training) -> tuple[DataFrame, DataFrame]:
    """Factors (id, vec) of all left and of all right ids.

    ``pairs``: left, right, n (how often observed), each pair in one row and both ids in ``lefts``
    (id) and ``rights`` (id, mass). ``mass`` weighs an id among drawn contexts. Ids without a pair
    keep their initial draw. The result depends on seed and rows, not on their partitioning.
    """
    pairs, seen = materialize_with(
        pairs.select(F.col("left").cast("bigint"), F.col("right").cast("bigint"), F.col("n").cast("bigint")),
        "grid-pairs", {"rows": F.count(F.lit(1)), "observed": F.sum("n")},
    )
    largest = max(lefts.count(), rights.count())
    blocks = _block_count(t, seen["rows"], largest, seen["observed"] or 0)
    share = max(1, (seen["observed"] or 0) // blocks)
    # Each heavy id has more than a block's share of the observations: there are fewer than blocks.
    heavy = pairs.groupBy(F.col("left").alias("id")).agg(F.sum("n").alias("n")).filter(F.col("n") > share)
    heavy = materialize(heavy.select("id", F.least(F.lit(blocks), F.ceil(F.col("n") / F.lit(share))).cast("int").alias("parts")), "heavy-ids")
    any_heavy = not heavy.isEmpty()
    parted = lefts.select(F.col("id").cast("bigint")).join(F.broadcast(heavy), "id", "left")
    parted = parted.select("id", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(0.0).alias("mass"))
    right = rights.select(F.col("id").cast("bigint"), F.lit(0).alias("part"), F.col("mass").cast("double").alias("mass"))
    factors = _initial(parted, 0, t, False).unionByName(_initial(right, 1, t, t.loss == "skipgram"))
    for epoch in range(t.epochs):
        deal = (t.seed, epoch)
        met = pairs.join(F.broadcast(heavy), F.col("left") == F.col("id"), "left").withColumn("to", _block((*deal, 1), blocks, "right"))
        met = met.select(F.col("left").alias("id"), F.pmod("to", F.coalesce("parts", F.lit(1))).alias("part"), F.col("right").alias("other"), "n", "to")
        met = met.withColumn("cell", _block((*deal, 0), blocks, "id", "part")).withColumn("round", F.pmod(F.col("to") - F.col("cell"), F.lit(blocks)))
        met = materialize(met.drop("to"), "grid-epoch", partition_by=["round"])
        for turn in range(blocks):
            on_right = F.pmod(_block((*deal, 1), blocks, "id") - F.lit(turn), F.lit(blocks))
            cell = F.when(F.col("kind") == 0, _block((*deal, 0), blocks, "id", "part")).otherwise(on_right)
            nothing = [F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("bigint").alias("n")]
            rows = factors.select(cell.alias("cell"), "*", *nothing)
            rows = rows.unionByName(met.filter(F.col("round") == turn).select("cell", F.lit(2).alias("kind"), "id", "part", "other", "n"), True)
            factors = _round(rows, blocks, _train_cell(t, (*deal, turn), blocks))
        factors = materialize(factors, "grid-factors")
        if any_heavy:
            factors = materialize(_averaged(factors.filter("kind = 0"), heavy).unionByName(factors.filter("kind = 1")), "grid-averaged")
    left, right = factors.filter("kind = 0"), factors.filter("kind = 1")
    vec = F.slice("vec", 1, t.dim).cast("array<double>").alias("vec")
    return left.filter("part = 0").select("id", vec), right.select("id", vec)
