"""Exact deduplication by recipes of content-defined chunks.

A text is cut where a rolling hash of its last bytes has a run of zero bits, so equal texts have
equal chunks. A chunk is known by its 128-bit hash. Chunks whose hash occurs more than once are
compared byte for byte: should different chunks share a hash, they are numbered apart. While the
repeated hashes are few they are sent to the tasks, and of the chunks only the repeated ones move, each
distinct one once per task; with more of them the other chunks are dropped after the exchange. A
document's recipe is the ordered list of its verified chunk identifiers, and documents are equal when
their recipes are. Long texts never travel as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import bounded, spread_join, text_of, utf8_slices
from seqloom.session import materialize

_WINDOW = 32
_gear = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunk_ends(buf: np.ndarray, offsets: np.ndarray, least: int, mean: int, most: int) -> list[np.ndarray]:
    """For each text the ends of its chunks, counted from its start; an empty text has none."""
    h = _gear[buf]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cuts = np.flatnonzero(h >> np.uint32(32 - int(mean).bit_length() + 1) == 0) + 1
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], lo
        while hi - at > least:
            i = np.searchsorted(cuts, at + least)
            cut = min(int(cuts[i]) if i < len(cuts) else hi, at + most, hi)
            ends.append(cut - lo)
            at = cut
        if at < hi:
            ends.append(hi - lo)
        out.append(np.array(ends, np.int64))
    return out


def _chunker(with_bytes: bool, sizes: tuple[int, int, int], hash_bytes: int):
    """Rows of texts -> recipes beside the columns after the text, or -> the chunks themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                buf = _LOWER[buf]
                whole = buf.tobytes()
                marks, recipes, hashes, chunks = [], [], [], []
                for at, end, ends in zip(offsets.tolist(), offsets[1:].tolist(), chunk_ends(buf, offsets, *sizes)):
                    own = [whole[at + b : at + e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
                    own_hashes = [xxhash.xxh3_128_digest(c)[:hash_bytes] for c in own]
                    if with_bytes:
                        hashes += own_hashes
                        chunks += own
                    else:
                        marks.append(hashlib.sha256(whole[at:end]).hexdigest())
                        recipes.append(b"".join(own_hashes))
                if with_bytes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes, pa.binary()), pa.array(chunks, pa.binary())], names=["chunk", "bytes"]
                    )
                else:
                    kept = [0, *range(2, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).slice(lo, hi - lo) for i in kept), pa.array(marks), pa.array(recipes, pa.binary())],
                        names=[*(batch.schema.names[i] for i in kept), "text_sha256", "recipe"],
                    )

    return run


def recipes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sizes: tuple[int, int, int] = (1024, 2048, 8192),
    hash_bytes: int = 16,
    row: list[str] | None = None,
) -> DataFrame:
    """doc_id, the columns ``row``, text_sha256 and recipe (the verified identifiers, one after another).

    ``sizes``: least, mean and greatest chunk length in bytes, the least being 32 or more.
    ``hash_bytes``: how much of a chunk's hash is used (less is for tests of collisions).
    """
    if sizes[0] < _WINDOW:
        raise ValueError(f"chunks must have {_WINDOW} bytes at least")
    named = [F.col(c).alias(f"row_{i}") for i, c in enumerate(row or [])]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), *named)
    types = "".join(f"row_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(row or []))
    table = materialize(
        rows.mapInArrow(_chunker(False, sizes, hash_bytes), f"doc_id bigint, {types}text_sha256 string, recipe binary"), "recipes"
    )
    rows = rows.select("doc_id", "text")
    places = F.explode(F.expr(f"sequence(1, cast(length(recipe) as int), {hash_bytes})")).alias("place")
    listed = table.filter("length(recipe) > 0").select("recipe", places)
    occurring = listed.select(F.expr(f"substring(recipe, place, {hash_bytes})").alias("chunk")).groupBy("chunk").count()
    repeated = bounded(materialize(occurring.filter("count > 1").select("chunk"), "repeated-chunks"))
    chunks = rows.mapInArrow(_chunker(True, sizes, hash_bytes), "chunk binary, bytes binary")
    distinct = chunks.join(repeated, "chunk", "left_semi").distinct()
    clashing = distinct.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk")
    clashing = materialize(clashing, "clashing")
    if clashing.isEmpty():
        return table
    return _numbered_apart(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), *named), types, clashing, sizes, hash_bytes)


def _joined(chunks: str):
    return F.coalesce(F.aggregate(chunks, F.lit("").cast("binary"), lambda a, c: F.concat(a, c)), F.lit("").cast("binary"))


def _numbered_apart(rows: DataFrame, types: str, clashing: DataFrame, sizes, hash_bytes: int) -> DataFrame:
    """Recipes where some hash stands for several chunks: these chunks add a second, longer hash
    of their bytes, and a document with one of them carries it in its recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [i for i in range(batch.num_columns) if i != 1]
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                buf = _LOWER[buf]
                whole = buf.tobytes()
                ids, marks, places, hashes, seconds = [], [], [], [], []
                for i, (at, end, ends) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), chunk_ends(buf, offsets, *sizes))):
                    mark = hashlib.sha256(whole[at:end]).hexdigest()
                    bounds = [0, *ends.tolist()]
                    for k in range(max(1, len(ends))):
                        chunk = whole[at + bounds[k] : at + bounds[k + 1]] if len(ends) else b""
                        ids.append(lo + i)
                        marks.append(mark)
                        places.append(k)
                        hashes.append(xxhash.xxh3_128_digest(chunk)[:hash_bytes] if len(ends) else b"")
                        seconds.append(hashlib.sha256(chunk).digest() if len(ends) else b"")
                found = [batch.column(i).take(pa.array(ids, pa.int64())) for i in others]
                yield pa.RecordBatch.from_arrays(
                    [*found, pa.array(marks), pa.array(places, pa.int32()), pa.array(hashes, pa.binary()), pa.array(seconds, pa.binary())],
                    names=[*(batch.schema.names[i] for i in others), "text_sha256", "place", "chunk", "second"],
                )

    own = ["doc_id", *(part.split()[0] for part in types.split(", ") if part)]
    schema = f"doc_id bigint, {types}number bigint, text_sha256 string, place int, chunk binary, second binary"
    parts = rows.withColumn("number", F.monotonically_increasing_id()).mapInArrow(run, schema)
    marked = parts.join(clashing.withColumn("clash", F.lit(True)), "chunk", "left")
    told = F.when(F.col("clash"), F.concat("chunk", "second")).otherwise(F.col("chunk"))
    listed = marked.groupBy("number", *own, "text_sha256").agg(
        F.sort_array(F.collect_list(F.struct("place", told.alias("chunk")))).alias("parts")
    )
    return materialize(listed.select(*own, "text_sha256", _joined(F.transform("parts", lambda p: p["chunk"])).alias("recipe")), "recipes")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: list[str] | None = None, **options) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, and the columns ``row``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of
    a group stays (an unknown id only where all are unknown). Rows that share this id all count as
    kept, unless ``row`` names columns that tell rows apart: then one row of a group is kept, the one
    with the largest values there.
    """
    table = recipes(docs, doc_id, text, row=row, **options)
    own = [f"row_{i}" for i in range(len(row or []))]
    kept = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", *own)).alias("keep")
    groups = materialize(table.groupBy("recipe").agg(kept, F.count(F.lit(1)).alias("group_size")), "equal-texts")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = spread_join(table, groups, ["recipe"], "group_size", total, own[-1] if own else "doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    for name in own:
        same = same & F.col(name).eqNullSafe(F.col(f"keep.{name}"))
    return joined.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "text_sha256", *[F.col(f"row_{i}").alias(c) for i, c in enumerate(row or [])]
    )
