"""Sum-of-squares packing of token pieces into sequences of one capacity.

Texts are cut only where they are longer than a sequence: into full pieces, of which the first may
be shorter. A full piece is a sequence. The others are dealt into bounded groups by a hash, and
each group is packed by itself, longest piece first: of the sequences with room, a piece goes where
the sum over all gaps of the squared number of open sequences with that gap becomes smallest (equal
sums: the fuller sequence); a sequence is begun where none has room. Sequences that became exactly
full stay; the pieces of the others are dealt into new, fewer groups and packed so again, until one
group holds them all or hardly any more become full. Only short rows of lengths move; texts never do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import text_of
from seqloom.llm.tokens import piece_encoder
from seqloom.session import materialize

GROUP_ITEMS = 8192
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of each whole text: its ids with ``end_id`` behind, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer, byte_level)
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(value) + end
                n = len(ids) // 4
                at = 0
                for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    rows.append((key, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text")).mapInArrow(cut, _PIECES)


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every item of one group, by least sum of squares, longest first."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by their fill
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        level = _least_squares(count, size, capacity)
        if level:
            bins[i] = open_bins[level].pop()
            count[level] -= 1
        else:
            bins[i] = n_bins
            n_bins += 1
        offsets[i] = level
        if level + size < capacity:
            open_bins[level + size].append(int(bins[i]))
            count[level + size] += 1
    return bins, offsets


def _least_squares(count: np.ndarray, size: int, capacity: int) -> int:
    """Fill of the open sequence to take; 0 (a new one) where none has room."""
    levels = np.flatnonzero(count[: capacity - size + 1])[::-1]
    if len(levels) == 0:
        return 0
    after = np.append(count, 0)[levels + size]
    # Leaving a gap with c sequences saves 2c - 1, joining one with c costs 2c + 1; an exact fit joins none.
    change = np.where(levels + size < capacity, 2 * (after - count[levels]) + 2, 1 - 2 * count[levels])
    return int(levels[np.argmin(change)])


def _pack_round(items: DataFrame, capacity: int, groups: int, round_no: int, last: bool) -> DataFrame:
    """Columns item, size -> item, size, seq, at, full; sequences are numbered by round and group."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item"], ascending=[False, True])
        sizes = rows["size"].to_numpy()
        bins, at = pack_group(sizes, capacity)
        full = np.bincount(bins, sizes)[bins] == capacity
        number = -((np.int64(round_no) << 56) | (np.int64(rows["grp"].iloc[0]) << 24) | bins) - 1
        return pd.DataFrame({"item": rows["item"].to_numpy(), "size": sizes, "seq": number, "at": at, "full": full | last})

    dealt = items.select("item", "size", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)).alias("grp"))
    packed = dealt.groupBy("grp").applyInPandas(pack, "item bigint, size bigint, seq bigint, at bigint, full boolean")
    return materialize(packed, f"packed-{round_no}")


def pack_pieces(pieces: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Offsets in a sequence have no gaps from 0 on. Lengths outside the range raise an error. An
    empty input gives an empty result; repeated rows are packed one by one.
    """
    pieces = materialize(pieces.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    items = pieces.filter(~F.col("length").eqNullSafe(capacity)).select(
        F.col("_item").alias("item"), F.col("length").alias("size")
    )
    wrong = F.coalesce(F.sum(F.expr(f"int(size is null or size < 1 or size > {capacity})")), F.lit(0))
    n, bad = items.agg(F.count(F.lit(1)), wrong).first()
    if bad:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    kept = [c for c in pieces.columns if c != "_item"]
    out = pieces.filter(F.col("length") == capacity).select(
        *kept, F.col("_item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    placed, round_no, before = [], 1, None
    while n:
        groups = -(-n // group_items)
        last = groups == 1 or (before is not None and n > 0.9 * before)
        step = _pack_round(items, capacity, groups, round_no, last)
        placed.append(step.filter("full"))
        if last:
            break
        items = step.filter("not full").select("item", "size")
        before, n, round_no = n, items.count(), round_no + 1
    if not placed:
        return out
    where = reduce(DataFrame.unionByName, placed).select(
        F.col("item").alias("_item"), F.col("seq").alias("sequence_id"), F.col("at").alias("offset")
    )
    return out.unionByName(pieces.join(where, "_item").select(*kept, "sequence_id", "offset"))
