"""Time-ordered user sequences, history frames and neighbour frames.

No step groups all rows of a user: long users are cut into blocks of consecutive positions
and each block also receives the rows just before it (or after it) that its frames reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seqloom.operators.ordering import number_rows

SPLIT_MODES = ("leave_last_two", "none")
PAD_ITEM = -1  # fixed value: filler of short histories
MAX_GROUP_ROWS = 1_000_000
BLOCK_ROWS = 4096
TASK_ROWS = 250_000  # of all users of one task, on average, where the number of rows is known


def index_interactions(interactions: DataFrame, user_map: DataFrame, item_map: DataFrame) -> DataFrame:
    """(user_id, item_id, ts) -> (user_idx, item_idx, ts). Rows with unmapped ids disappear."""
    return (
        interactions.join(user_map, "user_id")
        .join(item_map, "item_id")
        .select("user_idx", "item_idx", "ts")
    )


def number_positions(
    df: DataFrame,
    user: str = "user_idx",
    item: str = "item_idx",
    longest: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``pos`` (0-based, by ts then item) and ``seq_len`` to each row.

    ``longest`` is the largest number of rows of one user and ``rows`` that of all users, if the caller
    knows them. Users with more than ``max_group_rows`` rows are numbered through a global sort, all
    others in a window over their own rows. With ``rows`` the tasks grow in number, not in size: rows
    this narrow would otherwise be put together to about one large task a core.
    """
    df = df.select(user, item, "ts")
    tasks = -(-(rows or 0) // TASK_ROWS)
    if tasks > df.sparkSession.sparkContext.defaultParallelism:
        df = df.repartition(tasks, user)
    if longest is not None and longest <= max_group_rows:
        return _positions_by_window(df, user, item)
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("seq_len"))
    hot = sizes.filter(F.col("seq_len") > max_group_rows)
    if hot.isEmpty():
        return _positions_by_window(df, user, item)
    # Equal (user, ts, item) rows are identical; the salt only spreads them over ranges.
    salted = df.join(hot, user).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    numbered = number_rows(salted, [user, "ts", item, "_salt"], "_n")
    starts = numbered.groupBy(user).agg(F.min("_n").alias("_start"))
    long_part = numbered.join(starts, user).select(
        user, item, "ts", (F.col("_n") - F.col("_start")).cast("int").alias("pos"), "seq_len"
    )
    short_part = _positions_by_window(df.join(hot, user, "left_anti"), user, item)
    return short_part.unionByName(long_part)


def _positions_by_window(df: DataFrame, user: str, item: str) -> DataFrame:
    by_time = W.partitionBy(user).orderBy("ts", item)
    return df.select(
        user,
        item,
        "ts",
        (F.row_number().over(by_time) - 1).alias("pos"),
        F.count(F.lit(1)).over(W.partitionBy(user)).alias("seq_len"),
    )


def sequence_arrays(
    positions: DataFrame, user: str = "user_idx", item: str = "item_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(user, block, items): the ordered items of a user, in blocks of at most ``block_rows``."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", item)))
    blocked = positions.select(user, F.expr(f"pos div {block_rows}").alias("block"), "pos", item)
    return blocked.groupBy(user, "block").agg(pairs.getField(item).alias("items"))


def _blocks(
    positions: DataFrame, user: str, item: str, before: int, after: int, block_rows: int
) -> DataFrame:
    """Rows of ``positions`` with a block number, copied into the blocks whose frames reach them.

    ``own`` is false for copies. A block holds at most ``block_rows + before + after`` rows.
    """
    if max(before, after) > block_rows:
        raise ValueError("frames must not be longer than a block")
    block = F.expr(f"pos div {block_rows}")
    offset = F.col("pos") % block_rows
    homes = [F.struct(block.alias("block"), F.lit(True).alias("own"))]
    if before:
        reaches_next = (offset >= block_rows - before) & ((block + 1) * block_rows < F.col("seq_len"))
        homes.append(
            F.when(reaches_next, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
        )
    if after:
        reaches_previous = (offset < after) & (block > 0)
        homes.append(
            F.when(reaches_previous, F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
        )
    rows = positions.select(
        user, item, "pos", "seq_len", F.explode(F.array_compact(F.array(*homes))).alias("home")
    )
    return rows.select(user, item, "pos", "seq_len", "home.block", "home.own")


def split_label(pos: str = "pos", seq_len: str = "seq_len", mode: str = "leave_last_two"):
    """Split of a target position: last -> test, second last -> val, earlier -> train."""
    if mode not in SPLIT_MODES:
        raise ValueError(f"unknown split mode {mode!r}; expected one of {SPLIT_MODES}")
    if mode == "none":
        return F.lit("train")
    return (
        F.when(F.col(pos) == F.col(seq_len) - 1, "test")
        .when(F.col(pos) == F.col(seq_len) - 2, "val")
        .otherwise("train")
    )


def past_items(
    positions: DataFrame,
    history_len: int,
    user: str = "user_idx",
    item: str = "item_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows at positions >= 1 with ``past``: the up to ``history_len`` items before, in order. ``item`` may be any column."""
    if history_len < 1:
        raise ValueError("history_len must be at least 1")
    frame = W.partitionBy(user, "block").orderBy("pos").rowsBetween(-history_len, -1)
    return (
        _blocks(positions, user, item, history_len, 0, max(block_rows, history_len))
        .withColumn("past", F.collect_list(item).over(frame))
        .filter(F.col("own") & (F.col("pos") >= 1))
    )


def build_samples(
    positions: DataFrame,
    history_len: int = 50,
    mode: str = "leave_last_two",
    user: str = "user_idx",
    item: str = "item_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One sample per position >= 1: left-padded history, its mask, target and split."""
    samples = past_items(positions, history_len, user, item, block_rows)
    history = F.concat(
        F.array_repeat(F.lit(PAD_ITEM), F.lit(history_len) - F.size("past")), F.col("past")
    )
    return samples.select(
        split_label(mode=mode).alias("split"),
        user,
        "pos",
        history.alias("history"),
        F.transform(history, lambda x: x >= 0).alias("mask"),
        F.col(item).alias("target"),
        "seq_len",
    )


def context_pairs(
    positions: DataFrame,
    window: int = 5,
    user: str = "user_idx",
    item: str = "item_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(center, context, distance) for every later row at most ``window`` positions away.

    Each unordered pair of positions appears once; mirror it for the symmetric form.
    """
    block_rows = max(block_rows, window)
    frame = W.partitionBy(user, "block").orderBy("pos")
    ahead = F.array(
        *[
            F.struct(F.lit(d).alias("distance"), F.lead(item, d).over(frame).alias("context"))
            for d in range(1, window + 1)
        ]
    )
    return (
        _blocks(positions, user, item, 0, window, block_rows)
        .select("own", F.col(item).alias("center"), ahead.alias("ahead"))
        .filter("own")
        .select("center", F.inline("ahead"))
        .filter(F.col("context").isNotNull())
        .select("center", "context", "distance")
    )
