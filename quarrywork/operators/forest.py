"""Parents followed by doubling: after step i every row points 2**i parents up, so a chain of any length takes a number of steps that grows with its logarithm.

Rows are (group columns, id, up): up is the parent's id, null at the top. Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settle


def _step(state: DataFrame, group: list[str], combine: dict[str, Column], label: str) -> DataFrame:
    """Every row takes over its ancestor's values, named over_..., as `combine` says, and points where that points."""
    values = [c for c in state.columns if c not in (*group, "id", "up")]
    above = state.select(*group, F.col("id").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"over_{c}") for c in values], F.lit(True).alias("known"))
    moved = state.join(above, [*group, "up"], "left")
    return settle(moved.select(*group, "id", F.col("next").alias("up"), *[F.when(F.col("known"), combine[c]).otherwise(F.col(c)).alias(c) for c in values]), label)


def depths(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(group, id, depth) of the rows that reach a top, and the rows (group, id, up) that reach none: those on rings of parents and below them.

    Rows of a depth beyond 2**i have some at 2**i + 1, so a step that brings none to the top is the last.
    """
    state = settle(rows.select(*group, "id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")), "forest-depths")
    left = state.filter("up IS NOT NULL").count()
    while left:
        state = _step(state, group, {"depth": F.col("depth") + F.col("over_depth")}, "forest-depths")
        before, left = left, state.filter("up IS NOT NULL").count()
        if left == before:
            break
    lost = state.filter("up IS NOT NULL").select(*group, "id")
    return state.filter("up IS NULL").select(*group, "id", "depth"), rows.select(*group, "id", "up").join(lost, [*group, "id"], "left_semi")


def least_above(rows: DataFrame, group: list[str], rank: Column) -> DataFrame:
    """group, id, least: the smallest rank among a row and all above it. Rings are gone round as often as the doubling takes; a step that changes nothing is the last."""
    state = settle(rows.select(*group, "id", "up", rank.alias("least")), "forest-least")
    while True:
        new = _step(state, group, {"least": F.least("least", "over_least")}, "forest-least")
        changed = new.join(state.select(*group, "id", F.col("least").alias("old")), [*group, "id"]).filter(F.col("least") != F.col("old"))
        if changed.isEmpty():
            return new.select(*group, "id", "least")
        state = new


def any_below(rows: DataFrame, group: list[str], flag: Column, height: int) -> DataFrame:
    """group, id of the rows that have the flag or have one below that does; height: the depth of the deepest row."""
    state = settle(rows.select(*group, "id", "up", flag.alias("flag")), "forest-flags")
    for _ in range(height.bit_length()):
        lit = state.filter("flag AND up IS NOT NULL").select(*group, F.col("up").alias("id"), F.lit(True).alias("below")).distinct()
        lit = state.join(lit, [*group, "id"], "left").select(*group, "id", "up", (F.col("flag") | F.coalesce("below", F.lit(False))).alias("flag"))
        above = state.select(*group, F.col("id").alias("up"), F.col("up").alias("next"))
        state = settle(lit.join(above, [*group, "up"], "left").select(*group, "id", F.col("next").alias("up"), "flag"), "forest-flags")
    return state.filter("flag").select(*group, "id")
