"""Iterative k-core of user-item interactions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.session import materialize, materialize_with

TRACE_SCHEMA = "iteration int, rows_before bigint, rows_after bigint, n_users bigint, n_items bigint"
ID_BYTES = 64  # rough size of one dropped id in a broadcast table
BROADCAST_BYTES = 64 << 20
ALIVE, FALLEN, OLD = 0, 1, 2  # never below k; fell in this round; fell earlier


@dataclass(frozen=True)
class KCoreResult:
    """Surviving rows and ids, the rounds, and the rows of the longest surviving user.

    ``source`` are the rows before filtering, as written; joining them with id tables made
    from ``users`` and ``items`` drops the same rows as ``interactions`` does.
    """

    interactions: DataFrame
    source: DataFrame
    users: DataFrame
    items: DataFrame
    trace: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    max_user_rows: int = 0

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, TRACE_SCHEMA)


def _sides(rows: DataFrame, n: int, status: int | None) -> DataFrame:
    """Each row once for its user and once for its item, counting ``n``."""
    both = F.array(
        F.struct(F.lit("u").alias("kind"), F.col("user_id").alias("id")),
        F.struct(F.lit("i").alias("kind"), F.col("item_id").alias("id")),
    )
    return rows.select(F.inline(both)).select(
        "kind", "id", F.lit(n).cast("bigint").alias("n"), F.lit(status).cast("int").alias("status")
    )


def _gone(state: DataFrame, kind: str, column: str, n_gone: int) -> DataFrame:
    ids = state.filter((F.col("kind") == kind) & (F.col("status") > ALIVE)).select(
        F.col("id").alias(column), F.col("status").alias(f"{kind}_status")
    )
    return F.broadcast(ids) if n_gone * ID_BYTES <= BROADCAST_BYTES else ids


def _without(rows: DataFrame, state: DataFrame, n_gone: int) -> DataFrame:
    for kind, column in (("u", "user_id"), ("i", "item_id")):
        rows = rows.join(_gone(state, kind, column, n_gone), column, "left_anti")
    return rows


def _judge(changes: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """Add up the counts of every id and mark those that fall in this round.

    The new state is written and summarised by the same job.
    """
    counts = changes.groupBy("kind", "id").agg(F.sum("n").alias("n"), F.max("status").alias("status"))
    falls = (F.col("n") > 0) & (F.col("n") < k)
    status = F.when(F.col("status") > ALIVE, OLD).when(falls, FALLEN).otherwise(ALIVE)
    is_user, present = F.col("kind") == "u", F.col("n") > 0
    return materialize_with(
        counts.select("kind", "id", "n", status.alias("status")),
        "kcore-state",
        {
            "rows": F.coalesce(F.sum(F.when(is_user, F.col("n"))), F.lit(0)),
            "users": F.count_if(is_user & present),
            "items": F.count_if(~is_user & present),
            "fallen": F.count_if(F.col("status") == FALLEN),
            "gone": F.count_if(F.col("status") > ALIVE),
            "longest": F.coalesce(F.max(F.when(is_user, F.col("n"))), F.lit(0)),
        },
    )


def k_core(interactions: DataFrame, k: int = 5, max_iterations: int = 1000) -> KCoreResult:
    """Keep rows whose user and item both occur at least ``k`` times, until nothing changes.

    Users and items of one round are judged on the same rows, and repeated rows count. Rows
    are counted in full once; after that each round looks up only the rows lost with the ids
    that just fell below ``k`` and subtracts them from the counts. Such ids have fewer than
    ``k`` rows each, so they are never skewed, and they are broadcast while their known number
    is small. The (user, item) rows are rewritten once half of them are gone. Raises when
    ``max_iterations`` rounds do not reach the fixpoint.
    """
    source = materialize(interactions, "interactions")
    pairs = source.select("user_id", "item_id")
    state, stats = _judge(_sides(pairs, 1, ALIVE), k)
    trace: list[tuple[int, int, int, int, int]] = []
    written_rows = stats["rows"]
    for round_no in range(1, max_iterations + 1):
        rows, gone = stats["rows"], stats["gone"]
        if trace:
            trace[-1] = (*trace[-1][:2], rows, *trace[-1][3:])
        trace.append((round_no, rows, rows, stats["users"], stats["items"]))
        if stats["fallen"] == 0:
            left = state.filter(F.col("n") > 0)
            users = left.filter(F.col("kind") == "u").select(F.col("id").alias("user_id"))
            items = left.filter(F.col("kind") == "i").select(F.col("id").alias("item_id"))
            return KCoreResult(
                _without(source, state, gone), source, users, items, trace, stats["longest"]
            )
        if rows * 2 <= written_rows:
            # Rows of ids that fell in this round must stay: they are subtracted below.
            older = state.filter(F.col("status") == OLD)
            pairs, written_rows = materialize(_without(pairs, older, gone), "pairs"), rows
        lost = (
            pairs.join(_gone(state, "u", "user_id", gone), "user_id", "left")
            .join(_gone(state, "i", "item_id", gone), "item_id", "left")
            .filter(F.greatest("u_status", "i_status") == FALLEN)
        )
        state, stats = _judge(state.unionByName(_sides(lost, -1, None)), k)
    raise RuntimeError(f"k-core did not converge within {max_iterations} iterations")
