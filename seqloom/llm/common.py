"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqloom.session import materialize

SLICE_BYTES = 512 << 10
_MOST_HOT = 50_000
_SENT_ROWS = 250_000
_ROW_WISE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """``name``, longer where a column is called so already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two numbers that tell every row from all others, and these columns' names.

    They are a row's file and its place there, which no retry and no lost executor changes. What is
    not a plain scan of files is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROW_WISE and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        docs = materialize(docs, "rows")
    names = [fresh(docs.columns, name) for name in ("_file", "_index")]
    place = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(place["file_path"]).alias(names[0]), place["row_index"].alias(names[1])), names


def bounded(keys: DataFrame) -> DataFrame:
    """A written table of keys to be joined: sent to all tasks while its rows are few, else shuffled."""
    return F.broadcast(keys) if keys.limit(_SENT_ROWS + 1).count() <= _SENT_ROWS else keys


def utf8_slices(
    column: pa.Array, most: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes; a longer row is a run alone.

    Yields first row, end row, the bytes of the run, and its rows' offsets in these bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``keys`` anew, in batches of about ``least_rows`` that cut no group.

    What is held grows with the largest group, so groups must be bounded.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if size >= least_rows:
            last = [held[-1].column(k)[held[-1].num_rows - 1] for k in keys]
            differs = np.zeros(batch.num_rows, bool)
            for k, value in zip(keys, last):
                differs |= batch.column(k).to_numpy(zero_copy_only=False) != value.as_py()
            if differs.any():
                cut = int(differs.argmax())
                yield joined([*held, batch.slice(0, cut)] if cut else held)
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield joined(held)


def spread_join(rows: DataFrame, answers: DataFrame, keys: list[str], size: str, total: int, by: str) -> DataFrame:
    """``rows`` with the answer of their key, where ``answers`` has one row a key and ``size`` says how
    many of the ``total`` rows have it. Rows of a key with very many are dealt out to several tasks,
    by a hash of the column ``by``.

    A key counts as hot from a fixed share of all rows on, so the hot ones are few enough to broadcast.
    """
    bound = max(10_000, total // _MOST_HOT + 1)
    hot = answers.filter(F.col(size) > bound).select(*keys, F.ceil(F.col(size) / F.lit(bound)).cast("int").alias("_parts"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int"))
    parts = F.when(F.col(size) > bound, F.ceil(F.col(size) / F.lit(bound)).cast("int")).otherwise(1)
    copied = answers.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("_parts").join(copied, [*keys, "_part"]).drop("_part")
