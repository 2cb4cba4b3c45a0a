"""One query: a Spark plan, its SQL twin, and the columns both must return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    """``columns``: 'name:kind' with kind i (integer), s (text), b (boolean), f (number to six
    places), l (array, joined to text). ``sql`` may be None where no SQL equivalent exists.
    """

    name: str
    columns: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    ctes: tuple[str, ...] = ()

    def _fields(self) -> list[tuple[str, str]]:
        return [tuple(part.rsplit(":", 1)) for part in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_spark_column(n, k) for n, k in self._fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        head = f"WITH RECURSIVE {', '.join(self.ctes)} " if self.ctes else ""
        wanted = ", ".join(_sql_column(n, k) for n, k in self._fields())
        return f"{head}SELECT {wanted} FROM ({self.sql}) AS answer"


def _spark_column(name: str, kind: str):
    col = F.col(name)
    if kind == "i":
        out = col.cast("bigint")
    elif kind == "f":
        out = F.round(col.cast("double"), 6) + F.lit(0.0)
    elif kind == "l":
        out = F.array_join(col.cast("array<string>"), ",")
    elif kind == "b":
        out = col.cast("boolean")
    else:
        out = col.cast("string")
    return out.alias(name)


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "i":
        out = f"CAST({quoted} AS BIGINT)"
    elif kind == "f":
        out = f"round(CAST({quoted} AS DOUBLE), 6) + 0.0"
    elif kind == "l":
        out = f"array_to_string(CAST({quoted} AS VARCHAR[]), ',')"
    elif kind == "b":
        out = f"CAST({quoted} AS BOOLEAN)"
    else:
        out = f"CAST({quoted} AS VARCHAR)"
    return f"{out} AS {quoted}"
