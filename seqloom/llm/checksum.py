"""CRC-32C of many byte strings at once, and the masked form record files store.

The checksum is linear, so each 64-byte block is looked up alone and neighbouring blocks are then
combined pairwise, for all strings together, by tables that advance a checksum over zero bytes.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64
_POLYNOMIAL = 0x82F63B78  # fixed value: reflected Castagnoli polynomial
_MASK_DELTA = 0xA282EAD8  # fixed value of the record format


def _one_byte() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out.astype(np.uint32)


_T = [_one_byte()]
for _ in range(_BLOCK - 1):
    _T.append((_T[-1] >> np.uint32(8)) ^ _T[0][_T[-1] & np.uint32(255)])


def _advance(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = tables[0][value & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _over_a_block() -> np.ndarray:
    out = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        out = (out >> np.uint32(8)) ^ _T[0][out & np.uint32(255)]
    return out


_OVER_A_BLOCK = _over_a_block()


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Checksums of ``data[offsets[i]:offsets[i + 1]]`` for all i."""
    sizes = np.diff(offsets)
    if len(sizes) == 0:
        return np.zeros(0, np.uint32)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    counts = np.maximum((sizes + _BLOCK - 1) // _BLOCK, 1)
    ends = np.cumsum(counts) * _BLOCK
    padded = np.zeros(int(ends[-1]), np.uint8)
    padded[np.arange(len(data)) + np.repeat(ends - offsets[1:], sizes)] = data
    for k in range(4):
        padded[(ends - sizes + k)[sizes > k]] ^= np.uint8(255)
    blocks = padded.reshape(-1, _BLOCK)
    value = np.zeros(len(blocks), np.uint32)
    for j in range(_BLOCK):
        value ^= _T[_BLOCK - 1 - j][blocks[:, j]]
    tables = _OVER_A_BLOCK
    while counts.max() > 1:
        even = counts + (counts & 1)
        spread = np.zeros(int(even.sum()), np.uint32)
        at = np.arange(len(value)) + np.repeat(_starts(even) + (counts & 1) - _starts(counts), counts)
        spread[at] = value
        value = _advance(tables, spread[0::2]) ^ spread[1::2]
        tables = np.stack([_advance(tables, t) for t in tables])
        counts = even // 2
    short = np.uint64(0xFFFFFFFF) >> (np.minimum(sizes, 4) * 8).astype(np.uint64)
    return value ^ short.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that checksums of checksums stay sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)
