"""Computing an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it.

    Neighbouring projections and filters are merged by the optimizer, which repeats what they name
    more than once; a lambda's argument stays bound.
    """
    return F.transform(F.array(value), body)[0]


def select_where(df: DataFrame, columns: dict[str, Column], condition: Callable[[Column], Column]) -> DataFrame:
    """The columns of df, for rows on whose new columns the condition holds; every column is computed once.

    A plain filter would be moved below the projection and compute there what it asks for a second time.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(F.explode_outer(F.filter(F.array(row), condition)).alias("row")).where("row is not null").select("row.*")
