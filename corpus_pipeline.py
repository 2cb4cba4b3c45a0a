"""Corpus pipeline: toxic documents go, then exact copies, near copies and benchmark leaks; what
stays is packed. Every stage is written as Parquet and read again as the documents of the next.

Rows are told apart by their places in the files, so repeated and unknown ids are legal: of equal
texts, and of a component of near copies, one row stays whatever its id. Null texts count as empty:
one of them stays among exact copies, and none is a near copy or a leak. Further columns of documents
pass through the stages whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import decontaminate, exact, minhash, packing, toxicity
from seqloom.llm.common import bounded, fresh, table, with_row_keys
from seqloom.llm.queries import BYTE_END, BYTE_TOKENIZER, CAPACITY
from seqloom.llm.tokens import tokenizer_path
from seqloom.session import materialize, shared_root

ORACLE_SQL = None  # the stages' models, hashes and tokenizer are not SQL; tests hold brute force against them


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs.columns, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, name=name).filter(F.col(name) < 0.5).drop(name)


def _without_copies(docs: DataFrame, marked: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``marked`` keeps; rows are told apart by their places, not their ids."""
    keyed, names = with_row_keys(docs)
    gone = marked(keyed, names).filter("not kept").select(*[F.col(c).alias(f"_gone_{i}") for i, c in enumerate(names)])
    gone = bounded(materialize(gone, "copies"))
    same = [keyed[c] == gone[f"_gone_{i}"] for i, c in enumerate(names)]
    return keyed.join(gone, same, "left_anti").drop(*names)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without_copies(docs, lambda keyed, row: exact.exact_duplicates(keyed, row=row))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without_copies(docs, lambda keyed, row: minhash.near_duplicates(keyed, minhash.Settings(shingle=5), row=row))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), least_words=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, tokenizer_path(BYTE_TOKENIZER), True, BYTE_END, CAPACITY)
    return packing.pack_pieces(pieces, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_root(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
