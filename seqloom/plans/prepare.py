"""From raw interactions to indexed, time-ordered positions: computed once, used by all stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seqloom.operators.kcore import KCoreResult, k_core
from seqloom.operators.ordering import dense_index
from seqloom.operators.samples import assign_chunks, user_sizes
from seqloom.operators.sequences import build_samples, index_interactions, number_positions, past_items
from seqloom.session import materialize


@dataclass(frozen=True)
class Prepared:
    core: KCoreResult
    user_map: DataFrame
    item_map: DataFrame
    indexed: DataFrame
    positions: DataFrame
    sizes: DataFrame

    def samples(self, history_len: int = 50, mode: str = "leave_last_two") -> DataFrame:
        return build_samples(self.positions, history_len, mode)

    def history_names(self, history_len: int = 50) -> DataFrame:
        """(user_idx, pos, history_items): item ids of the histories, in order.

        A row meets its item's id once, before histories are framed, instead of once for every history
        it is in. Indexes ascend with ids, so that both order equal times alike.
        """
        named = self.indexed.join(self.item_map.select("item_idx", "item_id"), "item_idx").select("user_idx", "item_id", "ts")
        positions = number_positions(named, item="item_id", longest=self.core.max_user_rows, rows=self.core.trace[-1][2])
        return past_items(positions, history_len, item="item_id").select("user_idx", "pos", F.col("past").alias("history_items"))

    def chunks(
        self, history_len: int = 50, chunk_size: int = 1000, max_samples: int = 0, mode: str = "leave_last_two", drop_tail: bool = False
    ) -> DataFrame:
        return assign_chunks(self.samples(history_len, mode), self.sizes, chunk_size, max_samples, mode, drop_tail=drop_tail)


def prepare(interactions: DataFrame, k: int = 5) -> Prepared:
    """k-core, dense ids and positions of (user_id, item_id, ts) rows."""
    core = k_core(interactions.select("user_id", "item_id", "ts"), k)
    if core.trace[0][1] == 0:
        raise ValueError("no interactions")
    if core.trace[-1][2] == 0:
        raise ValueError(f"the {k}-core is empty")
    user_map = dense_index(core.users, "user_id", "user_idx", distinct=True)
    item_map = dense_index(core.items, "item_id", "item_idx", distinct=True)
    indexed = materialize(index_interactions(core.source, user_map, item_map), "indexed")
    positions = number_positions(indexed, longest=core.max_user_rows, rows=core.trace[-1][2])
    return Prepared(core, user_map, item_map, indexed, positions, user_sizes(indexed))
