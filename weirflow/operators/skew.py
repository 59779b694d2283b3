"""Joining rows with what is known of their group, when some groups are very large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000  # rows of one key from which it is joined without a shuffle
MAX_HOT_KEYS = 20_000  # keys that are broadcast; the limit above rises until no more than these lie beyond it


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """Inner join of `rows` with `groups`, which has one row per key and in `n` how many of the rows have it.

    Keys with `hot_rows` rows or more are joined by a broadcast, so their rows stay where they are;
    there are few of them, as each has so many rows, and their number is checked. All other keys are
    joined by a shuffle. Null keys match nothing. Both sides are read more than once, so they should be stored tables.
    """
    limit, hot = hot_rows, groups.where(F.col(n) >= hot_rows)
    while (found := hot.select(keys[0]).limit(max_hot + 1).count()) > max_hot:
        limit *= 10
        hot = groups.where(F.col(n) >= limit)
    if not found:
        return rows.join(groups, keys)
    hot = F.broadcast(hot)
    apart = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(n) < limit), keys)
    return rows.join(hot, keys).unionByName(apart)
