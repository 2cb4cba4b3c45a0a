"""Near-duplicate vectors of a label by counted collisions of one-dimensional projections.

1. Equal unit vectors of a label are one class. Classes are projected on ``Plan.size`` fixed random
   directions; two classes collide in one where their values differ by ``reach`` at most. For a pair at the
   threshold a direction's difference is normal with a known deviation, so the binomial law says
   how many of its collisions may be missing: ``Plan`` sets the window and the least count so that
   such a pair is lost with probability ``miss`` at most (nearer pairs still more rarely).
2. The first directions form ``_GROUPS`` groups, and a pair that misses fewer windows than there are
   groups collides in all directions of one group. There each class lies in one cell, two windows
   wide, and is shown to those later cells that its own window reaches: eight on average.
3. In a cell rows are sorted by one projection; every row's window is a stretch of that order. Pairs
   in it are counted over all directions. Only which classes have such a pair leaves the task.
4. Vectors are joined to these rows alone, the pairs are found again, and their cosines are computed
   in double precision. Sums of links and a spanning forest leave the task, so the rows that travel
   grow with the vectors and not with the pairs. Cells of very many rows are dealt out in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import spread_join, whole_groups
from seqloom.llm.components import components
from seqloom.session import materialize, materialize_with

_GROUPS, _DIMS = 3, 4
_DIRECTIONS = 24
_STEPS = 16  # whole steps in half a window
_WINDOW = _STEPS + 1  # rounding adds a step at most
_CELL = 2 * _WINDOW
_BLOCK = 65_536
_PAIRS = 1 << 20


def _lost(miss_one: float, n: int, allowed: int) -> float:
    """Probability that more than ``allowed`` of n windows are missed."""
    return 1 - sum(math.comb(n, i) * miss_one**i * (1 - miss_one) ** (n - i) for i in range(allowed + 1))


@dataclass(frozen=True)
class Plan:
    """``reach``: half a window; ``least``: collisions, of all directions, that a pair must have."""

    cosine: float = 0.98
    miss: float = 1e-6
    size: int = _DIRECTIONS

    def __post_init__(self):
        if not 0 < self.cosine < 1 or not 0 < self.miss < 1 or self.size < _GROUPS * _DIMS:
            raise ValueError("cosine and miss lie between 0 and 1, and the groups need their directions")

    @property
    def _sigmas(self) -> float:
        low, high = 0.1, 12.0
        for _ in range(60):
            middle = (low + high) / 2
            kept = _lost(math.erfc(middle / math.sqrt(2)), _GROUPS * _DIMS, _GROUPS - 1) <= self.miss / 2
            low, high = (low, middle) if kept else (middle, high)
        return high

    @property
    def reach(self) -> float:
        return self._sigmas * math.sqrt(2 - 2 * self.cosine)

    @property
    def least(self) -> int:
        one = math.erfc(self._sigmas / math.sqrt(2))
        return self.size - next(r for r in range(self.size) if _lost(one, self.size, r) <= self.miss / 2)

    def steps(self, unit: np.ndarray) -> np.ndarray:
        """Projections in whole steps, a bounded number of them; bounding keeps collisions."""
        rng = np.random.default_rng(7129)
        directions = np.stack([rng.standard_normal(self.size) for _ in range(unit.shape[1])])
        return np.clip(np.floor(unit @ directions * (_STEPS / self.reach)), -127, 127).astype(np.int8)


def _prepared(plan: Plan) -> Callable:
    """Rows of vectors -> mark (digest of the unit vector), dim, unit, steps; all null where unusable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                out: list[list] = [[None] * part.num_rows for _ in range(4)]
                vectors = part.column(2).to_pylist()
                by_dim: dict[int, list[int]] = {}
                for i, (v, label) in enumerate(zip(vectors, part.column(1).is_valid().to_pylist())):
                    if label and v and None not in v:
                        by_dim.setdefault(len(v), []).append(i)
                for dim, members in by_dim.items():
                    x = np.array([vectors[i] for i in members], np.float64) + 0.0
                    largest = np.abs(x).max(1)
                    fine = np.isfinite(x).all(1) & (largest > 0)
                    members, x = [i for i, f in zip(members, fine) if f], x[fine] / largest[fine][:, None]
                    unit = x / np.sqrt((x * x).sum(1))[:, None]
                    for i, u, s in zip(members, unit, plan.steps(unit)):
                        raw = u.tobytes()
                        out[0][i], out[1][i], out[2][i], out[3][i] = hashlib.blake2b(raw, digest_size=16).digest(), dim, raw, s.tobytes()
                types = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(o, t) for o, t in zip(out, types))],
                    names=["vec_id", "label", "mark", "dim", "unit", "steps"],
                )

    return run


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, kind, size, steps -> the row of its own cell and those of later cells its window reaches."""
    shifts = np.array(np.unravel_index(np.arange(1 << _DIMS), (2,) * _DIMS)).T
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            part = batch.slice(lo, 8192)
            n = part.num_rows
            steps = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int8).reshape(n, -1).astype(np.int64)
            for group in range(_GROUPS):
                own = steps[:, group * _DIMS : (group + 1) * _DIMS]
                cell = own // _CELL
                side = np.where(own - cell * _CELL < _WINDOW, -1, 1)
                cells = cell[:, None, :] + shifts[None] * side[:, None, :]
                # Cells as numbers, in lexicographic order; only later ones are shown the row.
                number = ((cells + 8) * (16 ** np.arange(_DIMS - 1, -1, -1))).sum(2)
                shown = number > number[:, :1]
                shown[:, 0] = True
                row, place = np.nonzero(shown)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(pa.array(row)),
                        pa.array(np.full(len(row), group, np.int8)),
                        pa.array(number[row, place].astype(np.int32)),
                        pa.array(place == 0),
                        *(part.column(c).take(pa.array(row)) for c in (0, 2, 3)),
                    ],
                    names=["kind", "group", "cell", "home", "node", "size", "steps"],
                )


_CELLS = "kind bigint, group tinyint, cell int, home boolean, node bigint, size bigint, steps binary"
_KEY = ["kind", "group", "cell", "lo", "hi"]


def _ranges(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with begin[i] <= j < end[i], a bounded number at a time."""
    total = np.concatenate([[0], np.cumsum(end - begin)])
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, "right")) - 1)
        own = np.repeat(np.arange(at, stop), (end - begin)[at:stop])
        yield own, np.arange(len(own)) + total[at] - total[own] + begin[own]
        at = stop


def _candidates(rows: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of whole cells that collide in all directions of the cell's group, in none of the
    groups before, and in ``least`` directions altogether."""
    n = rows.num_rows
    keys = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEY])
    block = rows.column("block").to_numpy(zero_copy_only=False)
    home = rows.column("home").to_numpy(zero_copy_only=False)
    steps = np.frombuffer(b"".join(rows.column("steps").to_pylist()), np.int8).reshape(n, -1).astype(np.int16)
    fresh = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
    number, group = np.cumsum(fresh), keys[1]
    own = np.stack([steps[np.arange(n), group * _DIMS + j] for j in range(_DIMS)], 1)
    # Sorted by cell and first projection; a window that leaves a cell's values reaches no other cell.
    place = number * 1024 + own[:, 0] + 256
    order = np.argsort(place, kind="stable")
    place = place[order]
    across = keys[3] != keys[4]
    for i, j in _ranges(np.arange(n) + 1, np.searchsorted(place, place + _WINDOW, "right")):
        i, j = order[i], order[j]
        fits = (home[i] | home[j]) & (~across[i] | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        for d in range(1, _DIMS):
            near = np.abs(own[i, d] - own[j, d]) <= _WINDOW
            i, j = i[near], j[near]
        hit = np.abs(steps[i] - steps[j]) <= _WINDOW
        first = hit[:, : _GROUPS * _DIMS].reshape(len(i), _GROUPS, _DIMS).all(2).argmax(1) if len(i) else np.zeros(0, np.int64)
        keep = (hit.sum(1) >= least) & (first == group[i])
        if keep.any():
            yield i[keep], j[keep]


def _involved(plan: Plan):
    """Rows of cells -> those of the rows that belong to some candidate pair."""
    least = plan.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, _KEY):
            found = np.zeros(rows.num_rows, bool)
            for i, j in _candidates(rows, least):
                found[i] = found[j] = True
            yield rows.filter(pa.array(found))

    return run


def _links(plan: Plan):
    """Rows of cells with vectors -> node, other, n: links of a class in this cell (other null), and
    the links of a spanning forest (n 0)."""
    least = plan.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, _KEY, 16_384):
            nodes = rows.column("node").to_numpy()
            sizes = rows.column("size").to_numpy()
            units = [np.frombuffer(u, np.float64) for u in rows.column("unit").to_pylist()]
            # ``kind`` is a hash: the labels themselves decide.
            told = rows.column("told").dictionary_encode().indices.to_numpy()
            counts = np.zeros(len(nodes), np.int64)
            parent = np.arange(len(nodes))
            forest: list[tuple[int, int]] = []

            def top(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in _candidates(rows, least):
                for at in range(0, len(i), 16_384):
                    a, b = i[at : at + 16_384], j[at : at + 16_384]
                    a, b = a[told[a] == told[b]], b[told[a] == told[b]]
                    if len(a) == 0:
                        continue
                    u, v = (np.stack([units[k] for k in side.tolist()]) for side in (a, b))
                    linked = (u * v).sum(1) >= plan.cosine
                    a, b = a[linked], b[linked]
                    np.add.at(counts, a, sizes[b])
                    np.add.at(counts, b, sizes[a])
                    for x, y in zip(a.tolist(), b.tolist()):
                        p, q = top(x), top(y)
                        if p != q:
                            parent[p] = q
                            forest.append((x, y))
            some = np.flatnonzero(counts)
            ends = np.array(forest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nodes[some], nodes[ends[:, 0]]])),
                    pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[ends[:, 1]]]), mask=np.arange(len(some) + len(ends)) < len(some)),
                    pa.array(np.concatenate([counts[some], np.zeros(len(ends), np.int64)])),
                ],
                names=["node", "other", "n"],
            )

    return run


def linked_vectors(
    vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-6, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows of equal, known label and equal length of vector are linked where their cosine, in double
    precision, is ``cosine`` or more. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. n_links counts the other rows linked directly, copies included;
    component_id is the smallest id that links reach, a row's own included, and ``kept`` marks the
    rows of that id (several where an id repeats). Unknown ids count where a component has no other,
    and its component_id is null then. Pairs with a cosine under ``cosine`` are never linked; a pair
    exactly there is overlooked with probability ``miss`` at most, by the draw of the directions.
    """
    plan = Plan(cosine, miss)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    schema = "vec_id bigint, label string, mark binary, dim int, unit binary, steps binary"
    sketched = materialize(rows.mapInArrow(_prepared(plan), schema), "projected")
    same = ["label", "dim", "mark"]
    grouped = sketched.filter("mark is not null").groupBy(*same).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("unit").alias("unit"), F.max("steps").alias("steps")
    )
    classes, seen = materialize_with(
        grouped.select("*", F.monotonically_increasing_id().alias("node"), F.xxhash64("label", "dim").alias("kind")), "vector-classes", {"n": F.sum("size")}
    )
    total = seen["n"] or 0

    cells = classes.select("node", "kind", "size", "steps").mapInArrow(_cell_rows, _CELLS)
    full = cells.groupBy("kind", "group", "cell").agg(F.count(F.lit(1)).alias("rows_in_cell")).filter(F.col("rows_in_cell") > _BLOCK)
    full = materialize(full.withColumn("blocks", F.ceil(F.col("rows_in_cell") / F.lit(_BLOCK)).cast("int")).drop("rows_in_cell"), "full-cells")
    # At most 16 ** 4 cells a group: the table of full ones is bounded by the cells, not by the vectors.
    dealt = cells.join(full, ["kind", "group", "cell"], "left").fillna(1, ["blocks"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [F.col(c) for c in ("kind", "group", "cell")] + [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    dealt = dealt.select(*columns, "block", "home", "node", "size", "steps")
    by_cell = lambda df: df.repartition(*_KEY).sortWithinPartitions(*_KEY)
    held = "kind bigint, group tinyint, cell int, lo int, hi int, block int, home boolean, node bigint, size bigint, steps binary"
    involved = materialize(by_cell(dealt).mapInArrow(_involved(plan), held), "colliding-rows")
    with_units = by_cell(involved.join(classes.select("node", "unit", F.concat_ws(":", "dim", "label").alias("told")), "node"))
    links = materialize(with_units.mapInArrow(_links(plan), "node bigint, other bigint, n bigint"), "vector-links")

    counts = links.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(links.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        *same, "rep", "size", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    answers = named.join(smallest, "root").select(*same, "size", "n_links", "component_id")
    told = spread_join(sketched.filter("mark is not null").select("vec_id", *same), answers, same, "size", total, "vec_id")
    linked = told.select("vec_id", "n_links", "component_id")
    alone = sketched.filter("mark is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
