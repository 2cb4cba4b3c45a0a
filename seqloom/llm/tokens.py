"""Token ids of whole texts by a public tokenizer file, with a bounded cache of encoded pieces.

Both kinds of file used here split a text at its spaces before anything else, so a text's ids
are the ids of its space-separated pieces one after another (tested against whole texts). Texts that
hold a special token's literal go whole through the library, which gives it its id. A piece
of Latin-1 letters, with or without closing marks, is one or two units of the file's own splitting
pattern and goes straight to the library's merge model; any other piece through its whole encoder.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array

_CACHE_ENTRIES = 400_000
# The white space of the byte-level pattern. Where a space touches more white
# space, its pieces depend on each other.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TOUCHING = re.compile(f" [{_SPACE}]|[{_SPACE}] | $")
_BYTE_PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_MARKS = string.punctuation.replace("'", "")  # the pattern gives the apostrophe rules of its own


def _byte_names() -> dict[int, str]:
    """The printable stand-ins of bytes: printable Latin-1 is itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_NAMES = _byte_names()


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Cache(dict):
    """Computes what it lacks; of two generations, the older one goes when the newer is full."""

    def __init__(self, compute):
        super().__init__()
        self._compute, self._older = compute, {}

    def __missing__(self, key):
        if len(self) >= _CACHE_ENTRIES:
            self._older = dict(self)
            self.clear()
        value = self._older.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) < 64:
            self[key] = value
        return value


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """``byte_level``: the file keeps letter case, and the space before a word belongs to it."""

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._special = [token.content for token in added]  # the library looks for these before all else
        self._byte_level = byte_level
        self._units = _Cache(self._encode_unit)
        self._first = _Cache(lambda piece: self._encode_piece("", piece))
        self._later = _Cache(lambda piece: self._encode_piece(" ", piece)) if byte_level else self._first

    def _encode_unit(self, unit: str) -> bytes:
        named = unit.encode().decode("latin-1").translate(_NAMES)
        return _packed([t.id for t in self._tokenizer.model.tokenize(named)])

    def _encode_piece(self, space: str, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if word.isalpha() and max(word) < "Ā":
            unit = space + word if self._byte_level else word.lower()
            marks = piece[len(word) :]
            return self._units[unit] + self._units[marks] if marks else self._units[unit]
        lines = piece.split("\n")
        if len(lines) > 1 and all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
            between = self._units["\n"] if self._byte_level else b""
            return (self._later if space else self._first)[lines[0]] + between + between.join(
                self._first[line] for line in lines[1:]
            )
        return _packed(self._tokenizer.encode(space + piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """All ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(token in text for token in self._special):
            return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
        if not self._byte_level:
            return b"".join(map(self._first.__getitem__, text.split(" ")))
        if _TOUCHING.search(text):
            return b"".join(map(self._first.__getitem__, _BYTE_PIECES.findall(text)))
        head, *rest = text.split(" ")
        return self._first[head] + b"".join(map(self._later.__getitem__, rest))


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def piece_encoder(path: str, byte_level: bool) -> PieceEncoder:
    """One encoder per file and worker process."""
    if (path, byte_level) not in _encoders:
        _encoders[path, byte_level] = PieceEncoder(path, byte_level)
    return _encoders[path, byte_level]
