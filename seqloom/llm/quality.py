"""Text quality by regularised quadratic discriminant analysis of document statistics.

Each whole text becomes a vector of transformed statistics (logarithms of sizes, log-odds of
shares). For either class the mean and covariance over all labelled training rows come from one
sum of moments; covariances are shrunk towards their pooled form and its diagonal. The score is
the logistic of the difference of the two log-densities, whose Mahalanobis distances use inverse
Cholesky factors computed once, and of the log prior odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import id_remainder, text_of, utf8_slices
from seqloom.llm.words import find_words
from seqloom.session import materialize

_SHARE_FLOOR = 1e-3


def _classes() -> np.ndarray:
    """Per byte: 0 other letter bytes, 1 capital, 2 small, 3 digit, 4 sentence mark, 5 symbol, 6 space, 7 line end."""
    out = np.zeros(256, np.int64)
    out[:128] = 5
    out[65:91], out[97:123], out[48:58] = 1, 2, 3
    out[[ord(c) for c in ".,;:'\"-()?"]] = 4
    out[[32, *range(9, 14)]] = 6
    out[10] = 7
    return out


_CLASS = _classes()


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text, finite for every text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _CLASS[buf], minlength=8 * n).reshape(n, 8).astype(float)
    words = find_words(buf, offsets)
    n_words = np.diff(words.first).astype(float)
    of = np.repeat(np.arange(n), np.diff(words.first))
    length = (words.ends - words.begins).astype(float)
    order = np.lexsort((words.hashes, of))
    h, o = words.hashes[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    begins = np.flatnonzero(fresh)
    runs = np.diff(np.append(begins, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[begins], runs)
    once = np.bincount(o[begins[runs == 1]], minlength=n)
    again = np.zeros(len(of), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])
    ends_odd = _CLASS[buf[words.ends - 1]] == 5
    alone_odd = ends_odd & (length == 1)
    marks_end = _CLASS[buf[words.ends - 1]] == 4
    safe = np.maximum(n_words, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 2], 1)
    mean_length = np.bincount(of, length, n) / safe
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / safe - mean_length**2, 0))
    packed = np.array([len(zlib.compress(buf[a:b].tobytes(), 1)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    odds = lambda share: np.log((share + _SHARE_FLOOR) / (1 - share + _SHARE_FLOOR))
    total = np.maximum(size, 1)
    columns = [
        np.log1p(n_words),
        np.log1p(mean_length),
        np.log1p(spread),
        odds(np.minimum(kinds[:, 1] / letters, 1)),
        odds(kinds[:, 3] / total),
        odds(kinds[:, 4] / total),
        odds(kinds[:, 5] / total),
        odds(np.minimum(kinds[:, 7] / total, 1)),
        odds(kinds[:, 0] / letters),
        np.log((distinct + 1) / (n_words**0.8 + 1)),
        odds(once / safe),
        odds(top / safe),
        odds(np.bincount(of, again, n) / safe),
        odds(np.bincount(of, ends_odd, n) / safe),
        odds(np.bincount(of, alone_odd, n) / safe),
        odds(np.bincount(of, marks_end, n) / safe),
        np.log((packed + 20) / (size + 20)),
    ]
    return np.stack(columns, 1)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``x``, the statistics of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                x = statistics(buf, offsets)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """``means[c]`` and ``whiten[c]``, the inverse Cholesky factor of class c; ``offset`` is the log
    prior odds plus half the difference of log-determinants."""

    means: np.ndarray
    whiten: np.ndarray
    offset: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten)]
        return 1 / (1 + np.exp(-np.clip((self.offset + (far[0] - far[1]) / 2) / self.temperature, -50, 50)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, x -> label, place, total: count, sums and sums of products, in one flat vector."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
        for c in np.unique(label):
            own = x[label == c]
            flat = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            sums[int(c)] = sums.get(int(c), 0) + flat
    for c, flat in sums.items():
        columns = [pa.array([c] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "place", "total"])


def fit(
    table: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 5, shrink: float = 0.1, ridge: float = 0.02,
    temperature: float = 1.0,
) -> Discriminant | None:
    """Fit on all labelled rows outside the held-out part; None if a class has no two rows."""
    marks = labels.filter(F.col(label).isNotNull() & (id_remainder(held_out) != 0)).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label")
    )
    known = table.join(marks, "doc_id").select("label", "x")
    sums = known.mapInArrow(_moments, "label int, place int, total double").groupBy("label", "place").agg(F.sum("total"))
    flat: dict[int, dict[int, float]] = {}
    for c, place, total in sums.collect():  # two classes times the number of moments
        flat.setdefault(c, {})[place] = total
    if any(flat.get(c, {}).get(0, 0) < 2 for c in (0, 1)):
        return None
    n, means, scatter = [], [], []
    for c in (0, 1):
        v = np.array([flat[c][k] for k in range(len(flat[c]))])
        d = int(round((np.sqrt(1 + 4 * (len(v) - 1)) - 1) / 2))
        n.append(v[0])
        means.append(v[1 : 1 + d] / v[0])
        scatter.append(v[1 + d :].reshape(d, d) - v[0] * np.outer(means[-1], means[-1]))
    pooled = sum(scatter) / sum(n)
    whiten, log_det = [], []
    for c in (0, 1):
        own = (1 - shrink) * scatter[c] / n[c] + shrink * (pooled + np.diag(np.diag(pooled))) / 2
        factor = np.linalg.cholesky(own + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(own)))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    offset = np.log(n[1] / n[0]) + (log_det[0] - log_det[1]) / 2
    return Discriminant(np.stack(means), np.stack(whiten), float(offset), temperature)


def score(table: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and ``score`` (0 to 1, higher: label 1 likelier) of every row of statistics; without
    a model every row scores one half."""
    if model is None:
        return table.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Score every row of ``docs`` after fitting on its labelled part."""
    table = materialize(document_statistics(docs), "statistics")
    return score(table, fit(table, labels, **options))
