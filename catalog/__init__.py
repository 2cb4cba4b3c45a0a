"""Queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations


def all_queries() -> list:
    from catalog import behaviour, coding, retrieval, texts, vectors

    return [*behaviour.QUERIES, *texts.QUERIES, *vectors.QUERIES, *coding.QUERIES, *retrieval.QUERIES]
