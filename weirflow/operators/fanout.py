"""Who else is to be published when a record changes: parents that embed it and observers that look at it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_LIMIT = 1000  # observers of one change that are published at once
OVERFLOW_DAYS = 0.1  # window of the replay that takes over beyond it


def parents(changes: DataFrame, foreign_key: str, table: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """Rows of the parent table that a change of a child updates; once each, or once per change without `distinct`.

    Once each is a semi join: the children are never multiplied into the parents.
    """
    keys = changes.where(F.col(foreign_key).isNotNull()).select(F.col(foreign_key).alias(key))
    return table.join(keys, key, "left_semi" if distinct else "inner")


def observes(changed: Column, attributes: list[str]) -> Column:
    """Whether a changeset (MAP by attribute) touches one of the observed attributes."""
    return F.arrays_overlap(F.map_keys(changed), F.array(*map(F.lit, attributes)))


def follow(changes: DataFrame, hops: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Records reached from the changes over a chain of associations; a change that reaches none vanishes.

    Each hop is (table, column so far, column of the table) of an equality join.
    """
    reached = changes
    for table, left, right in hops:
        reached = reached.join(table, reached[left] == table[right], "inner")
    return reached


def route(observers: DataFrame, change: list[str], limit: int = INLINE_LIMIT) -> DataFrame:
    """Per change: how many observers it has, and whether they are published inline or by a replay.

    Counted by an aggregate, so a change with very many observers is summed up before the shuffle.
    """
    return observers.groupBy(*change).agg(F.count("*").alias("n_observers")).withColumn("route", F.when(F.col("n_observers") > limit, "replay").otherwise("inline"))
