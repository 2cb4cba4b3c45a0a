"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and the beginnings of its longer words, hashed to 2^22
buckets. The machine adds to linear weights the products of low-rank vectors of every two terms
that occur together, so that a pair can count for more than its parts. It is fitted on a bounded
sample of labelled rows (``fit_rows``, the ones with the smallest hashes of their ids), over all
buckets of their whole texts that tell the classes apart by more than chance (``false_share``), however
many or rare these are. Other buckets weigh nothing. A model has at most 2^22 rows of 40 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from seqloom.llm.common import id_remainder, text_of, utf8_slices
from seqloom.llm.words import LETTERS, find_words
from seqloom.session import materialize

_BITS = 22
_BEGINNINGS = (4, 5)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; no run is empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


@dataclass
class FactorizationMachine:
    """Buckets in order; of each, its linear weight and then its factors."""

    terms: np.ndarray
    bias: float
    table: np.ndarray

    def places(self) -> np.ndarray:
        """Place of every bucket among the terms; -1 where the model has none."""
        where = np.full(1 << _BITS, -1, np.int32)
        where[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return where

    def score(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from (row, place of term) pairs in order, each of which occurs once."""
        x = self.table[places].astype(np.float64)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        z = np.full(n, self.bias)
        z[rows[starts]] += _margins(x, starts)[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _margins(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear part and pair products of each run of terms, and the sums they come from."""
    total = _sums(x, starts)
    own = _sums(np.einsum("ij,ij->i", x[:, 1:], x[:, 1:]), starts)
    return total[:, 0] + (np.einsum("ij,ij->i", total[:, 1:], total[:, 1:]) - own) / 2, total


def _term_pairs(buf: np.ndarray, offsets: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a run of texts, in order; with ``places``, the places of known buckets."""
    words = find_words(buf, offsets, LETTERS, _BEGINNINGS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    pairs = []
    for k, h in enumerate((words.hashes, *words.starts)):
        bucket = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        known = h != 0 if k else np.ones(len(h), bool)
        if places is not None:
            bucket = places[bucket].astype(np.int64)
            known &= bucket >= 0
        pairs.append((row[known] << _BITS) | bucket[known])
    found = np.unique(np.concatenate(pairs))
    return found >> _BITS, found & ((1 << _BITS) - 1)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> bucket, texts, marked (texts with label 1)."""
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
            rows, buckets = _term_pairs(buf, offsets)
            found, where, texts = np.unique(buckets, return_inverse=True, return_counts=True)
            marked = np.bincount(where, label[lo:hi][rows], len(found))
            columns = [pa.array(v.astype(np.int32)) for v in (found, texts, marked)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "texts", "marked"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: int = 5) -> DataFrame:
    """label, text of at most ``rows`` labelled documents outside the held-out part (written)."""
    marks = labels.filter(F.col(label).isNotNull() & (id_remainder(held_out) != 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    # One label per id, and a bounded number of ids: small enough for every task.
    chosen = marks.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id").select("label", "text"), "labelled")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    fit_rows: int = 24_000,
    rank: int = 8,
    epochs: int = 12,
    rate: float = 0.02,
    decay: float = 1e-4,
    seed: int = 7,
    false_share: float = 0.5,
) -> FactorizationMachine:
    """Without labelled rows every text scores one half; with one class only, near its label.

    Null and empty texts have no terms and teach only the bias. ``false_share`` is the part of the
    terms that may have been chosen by chance.
    """
    sample = labelled_sample(docs, labels, label, fit_rows)
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    model = FactorizationMachine(np.zeros(0, np.int32), bias, np.zeros((0, rank + 1), np.float32))
    if n == 0 or ones in (0, n):
        return model
    counts = sample.mapInArrow(_count_terms, "bucket int, texts int, marked int").groupBy("bucket").agg(
        F.sum("texts").cast("int").alias("texts"), F.sum("marked").cast("int").alias("marked")
    )
    # At most 2^22 rows of 12 bytes; a bucket of one text can be told by nothing but that text.
    model.terms = _telling(counts.filter("texts >= 2").toArrow(), ones / n, false_share)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = model.places()
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                rows, found = _term_pairs(buf, offsets, places)
                ends = pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["label", "places"])

    # Bounded by fit_rows: of each of these texts the terms that tell something.
    rows = sample.mapInArrow(known, "label int, places array<int>").toArrow().combine_chunks()
    lists = rows["places"].combine_chunks()
    label_of = rows["label"].to_numpy().astype(np.float32)
    return _train(model, lists.offsets.to_numpy(), lists.values.to_numpy(), label_of, rank, epochs, rate, decay, seed)


def _telling(counts: pa.Table, share: float, false_share: float) -> np.ndarray:
    """Buckets whose texts' classes differ from all texts' by more than chance, however many there are.

    A bucket's chance is bounded by its relative entropy (exact where all its texts are of one class).
    The bound on it is the largest at which chance would bring ``false_share`` of the chosen ones, or
    fewer.
    """
    n, k = (counts[c].to_numpy().astype(float) for c in ("texts", "marked"))
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = np.exp(-np.nan_to_num(k * np.log(k / (n * share))) - np.nan_to_num((n - k) * np.log((n - k) / (n * (1 - share)))))
    ascending = np.sort(chance)
    passed = np.flatnonzero(ascending * len(n) <= false_share * np.arange(1, len(n) + 1))
    least = ascending[passed[-1]] if len(passed) else -1
    return np.sort(counts["bucket"].to_numpy()[chance <= least])


def _train(model, first, places, label, rank, epochs, rate, decay, seed, batch_rows=256) -> FactorizationMachine:
    """Adam on the mean log-loss over mini-batches, which are dealt once and visited in another order each epoch."""
    rng = np.random.default_rng(seed)
    terms, bias = model.terms, model.bias
    # The rows' order comes from their content, not from the order they arrived in.
    digest = [zlib.crc32(places[lo:hi].tobytes()) for lo, hi in zip(first[:-1], first[1:])]
    order = np.lexsort((label, digest, np.diff(first)))
    order = order[rng.permutation(len(order))]
    theta = np.concatenate([np.zeros((len(terms), 1)), rng.normal(0, 0.05, (len(terms), rank))], 1).astype(np.float32)
    mean, square, t = np.zeros_like(theta), np.zeros_like(theta), 0
    batches = [order[at : at + batch_rows] for at in range(0, len(order), batch_rows)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            some = batches[b][first[batches[b] + 1] > first[batches[b]]]
            size = first[some + 1] - first[some]
            z, total = np.full(len(batches[b]), bias, np.float32), None
            if len(some):
                idx = np.concatenate([places[first[i] : first[i + 1]] for i in some])
                x = theta[idx]
                margin, total = _margins(x, np.cumsum(size) - size)
                z = np.concatenate([bias + margin, z[len(some) :]])
            goal = np.concatenate([label[some], label[batches[b][first[batches[b] + 1] == first[batches[b]]]]])
            error = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - goal) / len(goal)).astype(np.float32)
            bias -= rate * float(error.sum())
            if not len(some):
                continue
            grad = np.repeat(total, size, axis=0)
            grad -= x
            grad[:, 0] = 1
            grad *= np.repeat(error[: len(some)], size)[:, None]
            by = np.argsort(idx, kind="stable")
            starts = np.flatnonzero(np.diff(idx[by], prepend=-1))
            used = idx[by][starts]
            grad = _sums(grad[by], starts) + np.float32(decay) * theta[used]
            t += 1
            m, v = 0.9 * mean[used] + 0.1 * grad, 0.999 * square[used] + 0.001 * grad**2
            mean[used], square[used] = m, v
            theta[used] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return FactorizationMachine(terms, float(bias), theta)


def score(docs: DataFrame, model: FactorizationMachine, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, and as ``name`` the score of its whole text (0 to 1).

    Null and empty texts have the score of a text without terms; rows are scored one by one, whatever
    their ids. ``name`` must not be one of ``keep``.
    """
    if name in keep:
        raise ValueError(f"the result would have two columns {name!r}")
    own = [f"column_{i}" for i in range(len(keep))]
    kept = [F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)]
    # A string column that is kept is read where it is: no text goes to the tasks' Python twice.
    twice = text in keep and docs.schema[text].dataType == StringType()
    at = keep.index(text) if twice else len(own)
    kept = docs.select(*kept) if twice else docs.select(*kept, text_of(text).alias("whole_text"))
    schema = kept.select(*own).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = model.places()
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(at)):
                p = model.score(*_term_pairs(buf, offsets, places), hi - lo)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=[*own, "score"])

    return kept.mapInArrow(run, schema).select(*[F.col(o).alias(c) for c, o in zip(keep, own)], F.col("score").alias(name))
