"""Words of whole texts and their 64-bit hashes, computed for many texts at once.

A word is a longest run of bytes other than space and tab to carriage return; A-Z count as a-z.
The hash of a word is a polynomial in its bytes (read off a running sum over the buffer) that a
finalizer then mixes. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(20240611)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
# Letters of words: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``hashes`` of all words in order; the words of text i are ``first[i]:first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    starts: tuple[np.ndarray, ...] = ()


def word_spans(buf: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray = _SOLID) -> tuple[np.ndarray, ...]:
    """Which bytes belong to words, each text's first word, and where words begin and end."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, bool), np.zeros(len(offsets), np.int64), none, none
    solid = solid_bytes[buf]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    begin[heads] = solid[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = solid[tails]
    w0, w1 = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return solid, np.searchsorted(w0, offsets), w0, w1


def find_words(buf: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray = _SOLID, starts: tuple[int, ...] = ()) -> Words:
    """Words are runs of ``solid_bytes``. ``starts``: lengths of beginnings to hash as well; a word
    that is not longer than such a beginning has no hash of it (0)."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        nothing = np.zeros(0, np.uint64)
        return Words(nothing, np.zeros(len(offsets), np.int64), none, none, (nothing,) * len(starts))
    _, first, w0, w1 = word_spans(buf, offsets, solid_bytes)
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    hashes = mix((total[w1] - total[w0]) * inverse[w0])
    heads = []
    for size in starts:
        longer = w1 - w0 > size
        at = np.where(longer, w0 + size, w1)
        heads.append(np.where(longer, mix((total[at] - total[w0]) * inverse[w0] + _STEPS[size]), np.uint64(0)))
    return Words(hashes, first, w0, w1, tuple(heads))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with the offsets of each text's runs.

    A text of fewer words has its whole sequence as its only run, a text without words none.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    where = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=where[1:])
    out = np.zeros(where[-1], np.uint64)
    if len(h) >= size:
        runs = h[: len(h) - size + 1] * _STEPS[0]
        for j in range(1, size):
            runs = runs + h[j : len(h) - size + 1 + j] * _STEPS[j]
        text = np.repeat(np.arange(len(n)), n)
        at = first[text] + np.arange(len(out)) - where[text]
        full = counts[text] >= size
        out[full] = runs[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = h[first[i] : first[i + 1]]
        out[where[i]] = (own * _STEPS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), where
