"""Language identification by one bit-sliced Bloom filter of character n-grams.

All training texts are counted: an n-gram belongs to a language if its share of the language's
n-grams is at least ``min_share``, so a language has at most 1 / min_share of them. The filter is
one array of language bitmasks: an n-gram sets its languages' bits at ``probes`` places, and the
bitwise and of the masks at these places names all languages that may have it. A text's hits per
language are corrected for the false positives that the filter's load makes expect; the language
with most corrected hits is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import id_remainder, text_of, utf8_slices
from seqloom.llm.words import mix

UNKNOWN = "und"
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased letters, with one mark before and after each word.

    Returns the hashes, the text each belongs to, and whether each text has a letter.
    """
    joined = "\n".join(t.lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    if len(points) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    letter = _letter_table()[points]
    text = np.searchsorted(begins, np.arange(len(points)), "right") - 1
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    # One mark between words: other characters next to a former one go.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[begins[(begins > 0) & (begins <= len(points))] - 1] = True  # texts stay apart
    symbols = np.where(letter, points, 0).astype(np.uint64)[keep] + np.uint64(1)
    text = text[keep]
    if len(symbols) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    last = len(symbols) - n + 1
    h = np.zeros(last, np.uint64)
    for j in range(n):
        h = h + symbols[j : j + last] * _FACTORS[j]
    inside = np.ones(last, bool)
    for j in range(1, n - 1):
        inside &= symbols[j : j + last] > 1  # a mark only at either end
    inside &= text[:last] == text[n - 1 :]
    return mix(h[inside]), text[:last][inside], has


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            values = batch.column(1)
            for lo, hi, _, _ in utf8_slices(values):
                grams, text, _ = text_grams(values.slice(lo, hi - lo).to_pylist(), n)
                own = langs[lo:hi][text]
                for lang in sorted(set(own)):
                    found, counts = np.unique(grams[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))],
                        names=["lang", "gram", "count"],
                    )

    return run


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # one word of language bits per place and 64 languages
    false_rate: np.ndarray
    probes: int
    n: int

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that may contain each n-gram."""
        places = len(self.masks)
        out = None
        for k in range(self.probes):
            at = (mix(grams + np.uint64(k * int(_FACTORS[7]) % (1 << 64))) % np.uint64(places)).astype(np.int64)
            out = self.masks[at] if out is None else out & self.masks[at]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the corrected hits of the best over those of all."""
        grams, text, has = text_grams(texts, self.n)
        seen = self.languages_of(grams)
        total = np.bincount(text, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = (seen[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            raw = np.bincount(text, bit, len(texts))
            hits[:, i] = np.maximum(raw - total * self.false_rate[i], 0) / (1 - self.false_rate[i])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = hits.argmax(1)  # equal hits: the first language by name
        weight = hits.sum(1)
        score = np.divide(hits[np.arange(len(texts)), best], weight, out=np.zeros(len(texts)), where=weight > 0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
        return names, np.where(has, np.clip(score, 0, 1), 0.0)


def fit(
    docs: DataFrame, n: int = 3, min_share: float = 1e-4, probes: int = 3, places_per_gram: int = 12, held_out: int = 5
) -> LanguageFilter:
    """Fit on the texts with a language outside the held-out part."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(held_out) != 0))
    counted = (
        rows.select("lang", text_of().alias("text")).mapInArrow(_count(n), "lang string, gram bigint, count bigint")
        .groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    )
    totals = counted.groupBy("lang").agg(F.sum("count").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").filter(F.col("count") >= F.lit(min_share) * F.col("total"))
    kept = shares.select("lang", "gram").collect()  # 1 / min_share rows a language at most
    languages = sorted({r[0] for r in kept})
    places = 1 << max(10, int(np.ceil(np.log2(max(1, len({r[1] for r in kept}) * places_per_gram)))))
    masks = np.zeros((places, max(1, -(-len(languages) // 64))), np.uint64)
    model = LanguageFilter(languages, masks, np.zeros(len(languages)), probes, n)
    for i, lang in enumerate(languages):
        grams = np.array([r[1] for r in kept if r[0] == lang], np.int64).view(np.uint64)
        for k in range(probes):
            at = (mix(grams + np.uint64(k * int(_FACTORS[7]) % (1 << 64))) % np.uint64(places)).astype(np.int64)
            masks[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        load = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        model.false_rate[i] = min(load**probes, 0.99)
    return model


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; ``und`` and 0 where it has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            for lo, hi, _, _ in utf8_slices(values):
                names, score = model.decide(values.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
