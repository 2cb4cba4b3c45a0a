"""Token sequences in files of length-delimited binary records, with an offset index beside each.

A record is: payload length (8 bytes), masked CRC-32C of those 8 bytes (4), payload, masked
CRC-32C of the payload (4), all little-endian. A payload is the ids of one document, as 2-byte
unsigned integers where every id fits and as 4-byte ones otherwise. Beside ``<name>.rec`` lies
``<name>.idx``: per record the document id, whether it is not null, the record's offset in the
file and its number of ids, each as 8 bytes. A table of the files, one row each, completes a data
set; files of failed attempts are not in it and are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seqloom.llm.checksum import crc32c, masked
from seqloom.llm.common import text_of
from seqloom.llm.tokens import piece_encoder
from seqloom.session import shared_root

INDEX = np.dtype([("id", "<i8"), ("known", "<u8"), ("offset", "<u8"), ("n", "<u8")])
_FRAME = 16
_READ_BYTES = 4 << 20
_FILES = "file string, part int, records bigint, ids bigint, bytes bigint, id_bytes int"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def frame_records(payloads: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in payloads], "<u8")
    heads = sizes.view(np.uint8)
    head_crc = masked(crc32c(heads, np.arange(0, len(heads) + 1, 8))).astype("<u4")
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    tail_crc = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), offsets)).astype("<u4")
    out = []
    for size, head, payload, tail in zip(sizes, head_crc, payloads, tail_crc):
        out += (size.tobytes(), head.tobytes(), payload, tail.tobytes())
    return b"".join(out)


def open_records(data: bytes, starts: np.ndarray, counts: np.ndarray, id_bytes: int) -> list[np.ndarray]:
    """The id arrays of the records at ``starts`` in ``data``; raises if a check fails."""
    raw = np.frombuffer(data, np.uint8)
    n_bytes = counts.astype(np.int64) * id_bytes
    begin = starts.astype(np.int64)
    part = lambda at, size: raw[(at[:, None] + np.arange(size)).ravel()]
    heads = part(begin, 8)
    payload = [raw[b : b + n] for b, n in zip(begin + 12, n_bytes)]
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    joined = np.concatenate(payload) if payload else raw[:0]
    right = (
        np.array_equal(heads.view("<u8").astype(np.int64), n_bytes)
        and np.array_equal(part(begin + 8, 4).view("<u4"), masked(crc32c(heads, np.arange(0, len(heads) + 1, 8))))
        and np.array_equal(part(begin + 12 + n_bytes, 4).view("<u4"), masked(crc32c(joined, offsets)))
    )
    if not right:
        raise ValueError("a record differs from its checksum or its index")
    return [p.view(f"<u{id_bytes}") for p in payload]


def write_token_records(
    docs: DataFrame,
    tokenizer: str,
    byte_level: bool,
    end_id: int,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write records in ascending id order.

    Returns the table of files. One range of ids is one file, written by one task; ``partitions``
    is their number (default: that of shuffles). Null texts count as empty, null ids come first,
    equal ids stay next to each other; other columns are ignored. An empty input gives no files.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_root(spark)}/token-records-{uuid.uuid4().hex}"
    id_bytes = 2 if max(_vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    narrow = np.dtype(f"<u{id_bytes}")
    end = np.array([end_id], narrow).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer, byte_level)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        files, root = _filesystem(folder)
        out, index, at, n_ids = None, [], 0, 0
        try:
            for batch in batches:
                ids = batch.column(0)
                for lo in range(0, batch.num_rows, 1000):
                    payloads = [
                        np.frombuffer(encoder.encode(t), "<u4").astype(narrow).tobytes() + end
                        for t in batch.column(1).slice(lo, 1000).to_pylist()
                    ]
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(f"{root}/{name}.rec")
                    out.write(frame_records(payloads))
                    own = np.zeros(len(payloads), INDEX)
                    piece = ids.slice(lo, 1000)
                    own["id"] = piece.fill_null(0).to_numpy(zero_copy_only=False)
                    own["known"] = piece.is_valid().to_numpy(zero_copy_only=False)
                    sizes = np.array([len(p) for p in payloads])
                    own["offset"] = at + np.cumsum(sizes + _FRAME) - sizes - _FRAME
                    own["n"] = sizes // id_bytes
                    index.append(own.tobytes())
                    at += int((sizes + _FRAME).sum())
                    n_ids += int(own["n"].sum())
        finally:
            if out is not None:
                out.close()
        if out is not None:
            with files.open_output_stream(f"{root}/{name}.idx") as side:
                side.write(b"".join(index))
            row = [[name], [context.partitionId()], [sum(map(len, index)) // INDEX.itemsize], [n_ids], [at], [id_bytes]]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array(v, k) for v, k in zip(row, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "part", "records", "ids", "bytes", "id_bytes"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(doc_id).cast("bigint").alias("id"), text_of(text).alias("text"))
        .repartitionByRange(n, "id")
        .sortWithinPartitions("id")
    )
    ordered.mapInArrow(encode, _FILES).write.parquet(f"{folder}/files")
    return record_files(spark, folder)


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of a data set, with the number of ids in all files before it."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(_FILES).parquet(f"{folder}/files").select(
        F.lit(folder).alias("folder"), "*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before")
    )


def read_token_records(files: DataFrame, with_ids: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """Read data sets back, one file per task, checking every record.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned CRC-32
    of the ids as little-endian 4-byte integers), and ids unless ``with_ids`` is false. With
    ``shuffle_seed`` the records of each file come in random order, found through its index.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, root = _filesystem(row["folder"])
                with files.open_input_file(f"{root}/{row['file']}.idx") as side:
                    index = np.frombuffer(side.read(), INDEX)
                if len(index) != row["records"] or int(index["n"].sum()) != row["ids"]:
                    raise ValueError(f"the index of {row['file']} is not whole")
                start = row["before"] + np.cumsum(index["n"].astype(np.int64)) - index["n"].astype(np.int64)
                with files.open_input_file(f"{root}/{row['file']}.rec") as data:
                    for chosen, got in _runs(data, index, row["id_bytes"], row["part"], shuffle_seed):
                        wide = [x.astype("<u4") for x in got]
                        own = index[chosen]
                        columns = [
                            pa.array(own["id"].astype(np.int64), mask=own["known"] == 0),
                            pa.array(start[chosen]),
                            pa.array(own["n"].astype(np.int64)),
                            pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64()),
                        ]
                        if with_ids:
                            ends = np.concatenate([[0], np.cumsum(own["n"])]).astype(np.int32)
                            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wide).astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    tasks = max(1, files.count())
    return files.repartition(tasks).mapInArrow(decode, schema)


def _runs(data, index: np.ndarray, id_bytes: int, part: int, seed: int | None):
    """Records in bounded runs: neighbours by one read each, or single reads in random order."""
    if seed is not None:
        for i in np.random.default_rng([seed, part]).permutation(len(index)):
            size = int(index["n"][i]) * id_bytes + _FRAME
            raw = data.read_at(size, int(index["offset"][i]))
            yield np.array([i]), open_records(raw, np.zeros(1, np.int64), index["n"][[i]], id_bytes)
        return
    ends = index["offset"].astype(np.int64) + index["n"].astype(np.int64) * id_bytes + _FRAME
    lo = 0
    while lo < len(index):
        first = int(index["offset"][lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + _READ_BYTES, "right")))
        raw = data.read_at(int(ends[hi - 1]) - first, first)
        chosen = np.arange(lo, hi)
        yield chosen, open_records(raw, index["offset"][lo:hi].astype(np.int64) - first, index["n"][lo:hi], id_bytes)
        lo = hi
