"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

1. Texts become token batches of bounded size (distinct word hashes, training counts, token places),
   written once. Words are known by 64-bit hashes.
2. Distinct words of all batches meet by hash range, where training counts are summed exactly and
   answered to each batch; so no vocabulary is ever held whole.
3. Word pairs of the training texts meet by hash range too. Each range's pairs fill one slice of a
   Bloom filter: a pair with count c is entered once for each level up to 1 + log2(c).
4. Every token's pair is probed level by level. A filter that surely has ``part_bytes`` at most is
   broadcast. Beyond, its slices stay where they were filled: each batch sends its distinct pairs to
   them by range, once, and gets the levels back, so the work stays in proportion to the texts. Both
   ways probe the same bits. The probability mixes the recovered count with the word's own share
   (Dirichlet smoothing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import text_of, utf8_slices
from seqloom.llm.words import find_words, mix
from seqloom.session import materialize

_END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end of a text, as a token and before its first word
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F88969)
_KEY_SHIFT = np.uint64(16)  # pairs are told apart by 48 bits of their hash
_STEP, _PROBE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_RANGE_TOKENS = 4_000_000
_BATCH_BYTES = 512 << 10
_BATCHES = "batch bigint, doc_ids array<bigint>, known array<boolean>, training array<boolean>, lengths array<int>, hashes binary, counts binary, tokens binary"
_PROBES = 3
_BITS_PER_ENTRY = 8


def _pack(values: np.ndarray) -> bytes:
    """Ascending or small integers: differences by byte planes, compressed."""
    values = values.astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def token_batches(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bounded batches of whole texts (written); ``training`` says which texts are learned from."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), text_of(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(2), _BATCH_BYTES):
                words = find_words(buf, offsets)
                lengths = np.diff(words.first) + 1
                ends = np.cumsum(lengths)
                tokens = np.full(int(ends[-1]), _END, np.uint64)
                is_word = np.ones(len(tokens), bool)
                is_word[ends - 1] = False
                tokens[is_word] = words.hashes
                distinct, places = np.unique(tokens, return_inverse=True)
                learned = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                counts = np.bincount(places[np.repeat(learned, lengths)], minlength=len(distinct))
                ids = batch.column(0).slice(lo, hi - lo)
                packed = zstandard.ZstdCompressor(level=1).compress(places.astype("<u4").tobytes())
                columns = [
                    pa.array([number]),
                    pa.array([ids.fill_null(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([ids.is_valid().to_pylist()], pa.list_(pa.bool_())),
                    pa.array([learned.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths.tolist()], pa.list_(pa.int32())),
                    pa.array([_pack(distinct)], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([packed], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _BATCHES.split(", ")])
                number += 1

    return materialize(rows.mapInArrow(run, _BATCHES), "token-batches")


def _one_by_one(rows: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts; only one token batch at a time is copied out of Arrow memory."""
    for i in range(rows.num_rows):
        yield rows.slice(i, 1).to_pylist()[0]


def _tokens(row: dict) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<u4").astype(np.int64)


def _pair_keys(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key for every token and the one before it; before the first word stands the end of a text."""
    h = hashes[tokens]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(lengths) - lengths] = _END
    return mix(before * _LEFT + h * _RIGHT)


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where ascending keys pass from one range, given by their leading bits, to the next."""
    if bits == 0:
        return np.array([0, len(keys)])
    heads = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, heads), [len(keys)]])


def _emit(keys: np.ndarray, counts: np.ndarray, bits: int, batch: int) -> pa.RecordBatch:
    cuts = _cut(keys, bits)
    parts = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _, _ in parts], pa.int32()),
            pa.array([batch] * len(parts), pa.int64()),
            pa.array([_pack(keys[a:b]) for _, a, b in parts], pa.binary()),
            pa.array([_pack(np.cumsum(counts[a:b])) for _, a, b in parts], pa.binary()),
        ],
        names=["range", "batch", "keys", "counts"],
    )


_PARTS = "range int, batch bigint, keys binary, counts binary"


def _count(packed: bytes) -> np.ndarray:
    return np.diff(_unpack(packed), prepend=np.uint64(0)).astype(np.int64)


def word_counts(batches: DataFrame, bits: int) -> DataFrame:
    """batch, range, answer: the training counts of a batch's distinct words of a hash range, in
    order; batch -1 has the range's number of tokens and of distinct words instead (written)."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in _one_by_one(batch):
                yield _emit(_unpack(row["hashes"]), np.frombuffer(row["counts"], "<u4").astype(np.uint64), bits, row["batch"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        _, totals, where, cuts = _met(group)
        answers = [totals[where[a:b]].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:])]
        stats = np.array([totals.sum(), (totals > 0).sum()], "<i8").tobytes()
        return pd.DataFrame(
            {"batch": [*group["batch"], -1], "range": group["range"].iloc[0], "answer": [zstandard.compress(x, 1) for x in (*answers, stats)]}
        )

    asked = batches.select("batch", "hashes", "counts").mapInArrow(ask, _PARTS)
    return materialize(asked.groupBy("range").applyInPandas(answer, "batch bigint, range int, answer binary"), "word-counts")


def _met(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of all pieces of a range, their summed counts, the place of every piece's
    keys among them, and where the pieces begin and end."""
    keys = [_unpack(k) for k in group["keys"]]
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate([_count(c) for c in group["counts"]]), len(found)).astype(np.int64)
    return found, totals, where, cuts


def _filled(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Bits and bytes of the filter slice of one range's pairs; pairs that count 0 are not entered."""
    keys, counts = keys[counts > 0], counts[counts > 0]
    if len(keys) == 0:
        return 0, b""
    levels = 1 + np.floor(np.log2(counts)).astype(np.int64)
    n_bits = -(-int(levels.sum()) * _BITS_PER_ENTRY // 64) * 64
    bits_set = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max()) + 1):
        own = keys[levels >= level]
        for probe in range(_PROBES):
            bits_set[_place(own, level, probe, n_bits)] = True
    return n_bits, np.packbits(bits_set, bitorder="little").tobytes()


def pair_levels(batches: DataFrame, bits: int) -> DataFrame:
    """batch, range, answer: the levels that the slices tell for a batch's distinct pairs of a range of
    keys, in order (written)."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in _one_by_one(batch):
                lengths = np.array(row["lengths"], np.int64)
                keys = _pair_keys(_unpack(row["hashes"]), _tokens(row), lengths) >> _KEY_SHIFT << _KEY_SHIFT
                found, where = np.unique(keys, return_inverse=True)
                counts = np.bincount(where[np.repeat(np.array(row["training"], bool), lengths)], minlength=len(found))
                yield _emit(found, counts.astype(np.uint64), bits, row["batch"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        r = int(group["range"].iloc[0])
        found, totals, where, cuts = _met(group)
        n_bits, data = _filled(found, totals)
        # A pair that many batches hold is probed once.
        levels = PairFilter([(r, n_bits)], data, bits).levels(found).astype(np.uint8)
        answers = [zstandard.compress(levels[where[a:b]].tobytes(), 1) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"batch": group["batch"], "range": r, "answer": answers})

    columns = batches.select("batch", "training", "lengths", "hashes", "tokens")
    asked = columns.mapInArrow(ask, _PARTS).groupBy("range")
    return materialize(asked.applyInPandas(answer, "batch bigint, range int, answer binary"), "pair-levels")


def pair_slices(batches: DataFrame, bits: int) -> DataFrame:
    """range, n_bits, filter: one Bloom filter slice per range of pair keys (written)."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in _one_by_one(batch):
                lengths = np.array(row["lengths"], np.int64)
                keys = _pair_keys(_unpack(row["hashes"]), _tokens(row), lengths)
                keys = keys[np.repeat(np.array(row["training"], bool), lengths)]
                found, counts = np.unique(keys >> _KEY_SHIFT << _KEY_SHIFT, return_counts=True)
                if len(found):
                    yield _emit(found, counts.astype(np.uint64), bits, row["batch"])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        n_bits, data = _filled(*_met(group)[:2])
        return pd.DataFrame({"range": [group["range"].iloc[0]], "n_bits": [n_bits], "filter": [data]})

    columns = batches.select("batch", "training", "lengths", "hashes", "tokens")
    return materialize(
        columns.mapInArrow(ask, _PARTS).groupBy("range").applyInPandas(fill, "range int, n_bits bigint, filter binary"), "pair-slices"
    )


def _place(keys: np.ndarray, level: int, probe: int, n_bits) -> np.ndarray:
    shift = (level * int(_STEP) + probe * int(_PROBE)) % (1 << 64)
    return (mix(keys + np.uint64(shift)) % np.asarray(n_bits, np.uint64)).astype(np.int64)


class PairFilter:
    """Slices of some ranges; pairs of other ranges are taken as not entered."""

    def __init__(self, sizes: list[tuple[int, int]], data: bytes, bits: int):
        """``sizes``: range and bits of each slice, in the order in which ``data`` holds them."""
        self._bits = bits
        self._n_bits = np.zeros(1 << bits, np.int64)
        self._begin = np.zeros(1 << bits, np.int64)
        at = 0
        for r, n_bits in sizes:
            self._n_bits[r], self._begin[r] = n_bits, at
            at += n_bits // 8
        self._data = np.frombuffer(data, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each pair, found level by level until one is not there; 0 where none is."""
        out = np.zeros(len(keys), np.int64)
        ranges = (keys >> np.uint64(64 - self._bits)).astype(np.int64) if self._bits else np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self._n_bits[ranges] > 0)
        keys = keys >> _KEY_SHIFT << _KEY_SHIFT
        level = 0
        while len(alive):
            level += 1
            for probe in range(_PROBES):
                r = ranges[alive]
                at = _place(keys[alive], level, probe, self._n_bits[r])
                alive = alive[(self._data[self._begin[r] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = level
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return middle_counts(self.levels(keys))


def middle_counts(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for none."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1.0) - 0.5, 0.0)


def language_model_scores(
    docs: DataFrame, training: Column, smoothing: float = 1000.0, part_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words and one end; null counts as empty, so it is one token. Without
    training texts all counts are 0. ``training`` that is null counts as false.
    """
    spark = docs.sparkSession
    batches = token_batches(docs, training, doc_id, text)
    n_tokens = batches.select(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    # Ranges hold a bounded number of tokens whatever the input's size.
    bits = max(0, int(np.ceil(np.log2(max(1, n_tokens / _RANGE_TOKENS)))))
    counted = word_counts(batches, bits)
    told = counted.filter("batch = -1").select("answer").mapInArrow(_added_stats, "total bigint, distinct_words bigint")
    total, distinct = told.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()

    def listed(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias(name))

    asked = batches.drop("counts", "training").join(listed(counted.filter("batch >= 0"), "answers"), "batch")
    # A pair's levels are no more than its count, so the filter has one byte a token at most.
    if n_tokens * _BITS_PER_ENTRY <= 8 * part_bytes:
        slices = sorted(tuple(x) for x in pair_slices(batches, bits).collect())
        shared = spark.sparkContext.broadcast(([x[:2] for x in slices], b"".join(x[2] for x in slices)))
        asked = asked.withColumn("levels", F.lit(None).cast("array<struct<range:int,answer:binary>>"))
    else:
        shared = None
        asked = asked.join(listed(pair_levels(batches, bits), "levels"), "batch")
    scored = asked.mapInArrow(_scorer(shared, bits, total, distinct, smoothing), _SCORES)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def _added_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [np.frombuffer(zstandard.decompress(a), "<i8") for a in batch.column(0).to_pylist()]
        total, distinct = np.sum(stats, axis=0) if stats else (0, 0)
        yield pa.RecordBatch.from_arrays([pa.array([int(total)]), pa.array([int(distinct)])], names=["total", "distinct_words"])


_SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _joined_answers(answers: list[dict], kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(zstandard.decompress(a["answer"]), kind) for a in answers])


def _scorer(shared, bits: int, total: int, distinct: int, smoothing: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = PairFilter(*shared.value, bits) if shared is not None else None
        for batch in rows:
            for row in _one_by_one(batch):
                tokens, lengths = _tokens(row), np.array(row["lengths"], np.int64)
                counts = _joined_answers(row["answers"], "<i8")
                c = counts[tokens]
                hashes = _unpack(row["hashes"])
                end = counts[np.searchsorted(hashes, _END)]
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[np.cumsum(lengths) - lengths] = end
                share = (c + 1.0) / (total + distinct + 1.0)
                possible = np.flatnonzero((c > 0) & (before > 0))
                keys = _pair_keys(hashes, tokens, lengths)
                if pairs is not None:
                    recovered = pairs.counts(keys[possible])
                else:  # answers come in the order of the batch's distinct keys
                    where = np.unique(keys >> _KEY_SHIFT << _KEY_SHIFT, return_inverse=True)[1]
                    recovered = middle_counts(_joined_answers(row["levels"], np.uint8)[where[possible]])
                found = np.minimum(recovered, np.minimum(c, before)[possible])
                term = np.zeros(len(c))
                term[possible] = np.log10(1 + found / (smoothing * share[possible]))
                base = np.log10(share)
                term += np.log10(smoothing / (before + smoothing)) + base
                doc = np.repeat(np.arange(len(lengths)), lengths)
                n = len(lengths)
                ids = pa.array(np.array(row["doc_ids"], np.int64), mask=~np.array(row["known"], bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lengths), pa.array(np.bincount(doc, c > 0, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, term, n))],
                    names=[f.split()[0] for f in _SCORES.split(", ")],
                )

    return run
