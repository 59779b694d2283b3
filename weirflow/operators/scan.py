"""Running aggregates per key that survive a key holding a large part of all rows.

A plain window over a hot key sorts that key in one task. Here every key is cut into blocks along
the order; each block is summarised before the shuffle, what the blocks before it add up to is
carried in as one more row, and the window runs inside (key, block) only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.sources.tables import stored

_CARRY = "__carry"


def running(
    rows: DataFrame,
    keys: list[str],
    block: str,
    order: list[str],
    state: str,
    out: str,
    combine: Callable[[Column], Column] = F.max,
    backwards: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add `out`: `combine` (max or min) of `state` over the rows of the same keys up to this row.

    `block` must rise with `order`. Null states add nothing; where nothing was seen `out` is null.
    Rows that tie in `order` are taken in any order, so let `order` be total where that matters.
    `backwards` runs from the end; without `inclusive` the row itself doesn't count. An empty table gives an empty one.
    """
    at = F.col(block).desc() if backwards else F.col(block).asc()
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, block)
        .agg(combine(state).alias(state))
        .withColumn(state, combine(state).over(before))
        .where(F.col(state).isNotNull())
        .withColumn(_CARRY, F.lit(True))
    )
    every = rows.withColumn(_CARRY, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    inner = Window.partitionBy(*keys, block).orderBy(
        F.col(_CARRY).desc(), *(F.col(o).desc() if backwards else F.col(o).asc() for o in order)
    )
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return every.withColumn(out, combine(state).over(inner)).where(~F.col(_CARRY)).drop(_CARRY)


def positions(rows: DataFrame, order: list[str], out: str, cells: int | None = None) -> DataFrame:
    """Add `out`: each row's position from 0 in the order of these columns, which should be total.

    Rows are sorted by ranges that hold about as many of them each, whatever the values; every range
    counts its own and begins where the ranges before it end. The window without keys runs over one row
    per range. `cells` is the number of ranges, by default the session's shuffle partitions. The result is a stored table's.
    """
    apart = rows.repartitionByRange(*(() if cells is None else (max(1, cells),)), *order)
    apart = stored(apart.withColumn("__cell", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    first = apart.groupBy("__cell").agg(F.count("*").alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(*order)) - 1
    return apart.join(F.broadcast(first), "__cell").withColumn(out, F.col("__before") + inside).drop("__cell", "__before")
