"""Periodic runs of words: multi-scale minimizers, and direct lag scans for short periods.

Many texts are searched at once as one sequence of word numbers (equal numbers: identical words),
with a number that occurs once between texts, so no run can cross a border.

* Periods under ``_SHORT``: the sequence is compared with itself at every such lag.
* Longer periods q, by scales of lo <= q < hi: grams of hi - 1 words are hashed, and of every window
  of 2 * lo - hi + 2 neighbouring grams the smallest hash is kept. In a run of three periods some
  window lies in the run together with its copy one period on, so both keep the same gram; and as the
  gram is no shorter than the period, its next occurrence is exactly one period away. So neighbours
  of equal kept hash at a distance in the scale seed all runs. Each seed is extended word by word
  unless a run found before holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import text_of, utf8_slices
from seqloom.llm.words import mix, word_spans

_SHORT = 16
_FACTORS = np.random.default_rng(5501).integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _gram_hashes(seq: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` numbers, from hashes of halves that may overlap."""
    h = mix(seq.astype(np.uint64))
    at, level = 1, 0
    while 2 * at <= size:
        h = h[:-at] * _FACTORS[level] + h[at:]
        at, level = 2 * at, level + 1
    rest = size - at
    return mix(h[: len(h) - rest] * _FACTORS[64 + level] + h[rest:] if rest else h)


def _primitive(seq: np.ndarray, start: int, period: int) -> bool:
    """Whether the first period is no repetition of a shorter one."""
    rest, prime, parts = period, 2, []
    while prime * prime <= rest:
        if rest % prime == 0:
            parts.append(prime)
            while rest % prime == 0:
                rest //= prime
        prime += 1
    parts += [rest] if rest > 1 else []
    return not any(np.array_equal(seq[start : start + period - period // p], seq[start + period // p : start + period]) for p in parts)


def _short_runs(seq: np.ndarray, least: int, repeats: int, below: int) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, min(below, len(seq))):
        differ = np.flatnonzero(seq[lag:] != seq[:-lag])
        begin = np.concatenate([[0], differ + 1])
        same = np.concatenate([differ, [len(seq) - lag]]) - begin
        for i in np.flatnonzero(same >= max(least, repeats * lag) - lag).tolist():
            if _primitive(seq, int(begin[i]), lag):
                yield int(begin[i]), int(same[i]) + lag, lag


def _reach(seq: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (step 1) or before it (step -1) equal those ``lag`` further."""
    done, block = 0, 64
    while True:
        if step > 0:
            a, b = seq[at + done : at + done + block], seq[at + done + lag : at + done + lag + block]
            a = a[: len(b)]
        else:
            lo = max(0, at - done - block)
            a, b = seq[lo : at - done][::-1], seq[lo + lag : at - done + lag][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done += len(a)
        if len(a) < block:
            return done
        block *= 2


def _long_runs(seq: np.ndarray, least: int, repeats: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """Runs of a period from lo to hi - 1; each may come several times."""
    size = hi - 1
    width = 2 * lo - size + 1
    if len(seq) < size + width:
        return
    grams = _gram_hashes(seq, size)
    low = _sliding(np.minimum, grams, width)
    edge = np.zeros(width - 1, np.uint64)
    kept = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([edge, low, edge]), width))
    kept = kept[np.argsort(grams[kept], kind="stable")]
    apart = np.diff(kept)
    seeds = np.flatnonzero((grams[kept[1:]] == grams[kept[:-1]]) & (apart >= lo) & (apart < hi))
    ends: dict[int, int] = {}  # per lag, where the stretch found last ends
    for at, lag in sorted(zip(kept[seeds].tolist(), apart[seeds].tolist())):
        if at < ends.get(lag, 0):
            continue
        before, after = _reach(seq, at, lag, -1), _reach(seq, at, lag, 1)
        ends[lag] = at + after
        length = before + after + lag
        if length >= max(least, repeats * lag) and _primitive(seq, at - before, lag):
            yield at - before, length, lag


def find_runs(texts: list[np.ndarray], least: int = 24, repeats: int = 3, short: int = _SHORT) -> list[list[tuple[int, int, int]]]:
    """Per sequence of word numbers (0 and up) its runs (start, length, smallest period), in order.

    ``repeats`` is 3 at least: the scales rely on it.
    """
    if repeats < 3:
        raise ValueError("a run must have three periods at least")
    found: list[set] = [set() for _ in texts]

    def search(members: list[int], finder) -> None:
        borders = np.cumsum([0, *(len(texts[i]) + 1 for i in members)])
        seq = np.empty(borders[-1], np.int64)
        for k, i in enumerate(members):
            seq[borders[k] : borders[k + 1] - 1] = texts[i]
            seq[borders[k + 1] - 1] = -1 - k
        for start, length, period in finder(seq):
            k = int(np.searchsorted(borders, start, "right")) - 1
            found[members[k]].add((start - int(borders[k]), length, period))

    everyone = [i for i, t in enumerate(texts) if len(t) >= least]
    if everyone:
        search(everyone, lambda seq: _short_runs(seq, least, repeats, short))
    lo = short
    while members := [i for i in everyone if len(texts[i]) >= repeats * lo]:
        hi = lo + (lo + 1) // 2
        search(members, lambda seq: _long_runs(seq, least, repeats, lo, hi))
        lo = hi
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


def _finder(least: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                solid, first, begins, ends = word_spans(buf, offsets)
                data, sizes = buf[solid], ends - begins
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
                numbers = words.dictionary_encode().indices.to_numpy()
                runs = find_runs([numbers[a:b] for a, b in zip(first[:-1], first[1:])], least, repeats)
                change = np.zeros(len(sizes) + 1, np.int64)
                for base, own in zip(first.tolist(), runs):
                    for start, length, period in own:
                        change[base + start + period] += 1
                        change[base + start + length] -= 1
                stays = np.cumsum(change)[:-1] == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), _run_lists(runs), _joined(data, sizes, stays, first)],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def _run_lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    structs = pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], ["start", "length", "period"])
    where = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(where), structs)


def _joined(data: np.ndarray, sizes: np.ndarray, stays: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per text its words that stay, joined by one space; ``data`` holds all words end to end."""
    data, kept = data[np.repeat(stays, sizes)], sizes[stays]
    counts = np.concatenate([[0], np.cumsum(stays)])[first]  # of words that stay, before each text
    spaced = np.ones(len(kept), bool)
    spaced[counts[1:][np.diff(counts) > 0] - 1] = False  # the last word of a text
    out = np.insert(data, np.cumsum(kept)[spaced], 32)
    length = np.concatenate([[0], np.cumsum(kept + spaced)])[counts]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(length.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def periodic_runs(docs: DataFrame, least_words: int = 24, least_repeats: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of other than white space, taken as they are. A run is a stretch of
    ``max(least_words, least_repeats * period)`` words or more with that smallest period which no
    neighbouring word extends. ``collapsed`` is the text without the words that some run holds after
    its first period, joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``; every row is answered for itself, whatever its id; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(_finder(least_words, least_repeats), f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string")
