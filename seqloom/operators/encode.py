"""Item vectors from text and images through caller-supplied encoders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.functions import vector as V

_SCHEMA = "item_idx int, vec array<double>"


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.maximum(norms, V.EPSILON)


def encode_texts(texts: DataFrame, make_encoder: Callable[[], Callable], batch_size: int = 64) -> DataFrame:
    """(item_idx, vec): unit vectors of ``text``.

    ``make_encoder`` is called once per task and returns ``list of str -> 2-D array``.
    """

    def run(frames):
        encoder = None
        for frame in frames:
            encoder = encoder or make_encoder()
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vecs = _unit_rows(np.asarray(encoder(part["text"].tolist()), dtype=np.float64))
                yield part[["item_idx"]].assign(vec=list(vecs))

    return texts.select("item_idx", "text").mapInPandas(run, _SCHEMA)


def hashed_text_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """(item_idx, vec): unit TF-IDF vectors over hashed words; needs no model."""
    words = Tokenizer(inputCol="text", outputCol="words").transform(texts.select("item_idx", "text"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=dim).transform(words)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    dense = weighted.select("item_idx", vector_to_array("tfidf").alias("vec"))
    return dense.select("item_idx", V.l2_normalize("vec").alias("vec"))


def encode_images(
    spark: SparkSession, resolved: DataFrame, root: str, make_encoder: Callable[[], Callable], dim: int, batch_size: int = 32
) -> DataFrame:
    """(item_idx, vec, missing): unit vectors of image bytes.

    The encoder maps a list of byte strings to a list of vectors, None for bytes it cannot
    read. Items without a readable image get zeros.
    """
    content = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    )
    rows = resolved.select("item_idx", "path").join(content, "path", "left").select("item_idx", "content")

    def run(frames):
        encoder = None
        for frame in frames:
            encoder = encoder or make_encoder()
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vecs = np.zeros((len(part), dim))
                have = [i for i, c in enumerate(part["content"]) if c is not None]
                out = encoder([part["content"].iloc[i] for i in have]) if have else []
                read = [(i, v) for i, v in zip(have, out) if v is not None]
                for i, v in read:
                    vecs[i] = v
                missing = np.ones(len(part), bool)
                missing[[i for i, _ in read]] = False
                yield part[["item_idx"]].assign(vec=list(_unit_rows(vecs)), missing=missing)

    return rows.mapInPandas(run, _SCHEMA + ", missing boolean")


def require_some_images(encoded: DataFrame, allow_all_missing: bool = False) -> DataFrame:
    if not allow_all_missing and encoded.filter(~F.col("missing")).isEmpty():
        raise ValueError("no item has a readable image")
    return encoded
