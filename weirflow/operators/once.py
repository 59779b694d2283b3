"""Problem 5: messages delivered more than once.

A message is known by its producer (a model's record) and a number in that producer's sequence (the
instant of the update). Numbers already seen are kept as disjoint ranges per producer, cut at block
edges; a number that no range covers is accepted once, and the ranges are merged with it. Messages
whose identifier can't be read that way are resolved by exact lookup of the text they came with.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.sources.tables import stored

BLOCK = 1 << 20  # numbers in one block, the most that one window of a producer can hold

RANGES = "producer string, block bigint, lo bigint, hi bigint"


def identified(messages: DataFrame, producer: Column, number: Column, exact: Column, arrival: str, *carry: str) -> DataFrame:
    """Identifiers as they are needed: arrival, producer and number where both can be read, else the exact text. Written once, as reading them costs more than keeping them."""
    readable = producer.isNotNull() & number.isNotNull()
    read = messages.select(
        F.col(arrival).alias("arrival"), F.when(readable, producer).alias("producer"), F.when(readable, number).alias("number"), F.when(~readable, exact).alias("exact"), *carry
    )
    return stored(read, "identifiers")


def _swept(read: DataFrame, seen: DataFrame | None) -> DataFrame:
    """First arrivals of the numbers, and the seen ranges, in the order of their beginnings: producer, block, lo, hi, arrival (null for a range), and reach, how far what lies before covers."""
    # Copies collapse before the shuffle.
    claims = read.where("producer is not null").groupBy("producer", "number").agg(F.min("arrival").alias("arrival"))
    points = claims.select("producer", F.floor(F.col("number") / BLOCK).alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi"), "arrival")
    if seen is not None:
        points = points.unionByName(seen.select("producer", "block", "lo", "hi", F.lit(None).cast("bigint").alias("arrival")))
    return points.withColumn("reach", F.max("hi").over(_before()))


def _before():
    # A range of `seen` sorts before a number that it starts with, so the number counts as covered.
    return Window.partitionBy("producer", "block").orderBy("lo", F.col("arrival").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)


def uncovered(swept: DataFrame) -> DataFrame:
    """Arrivals of the numbers that no range covers."""
    return swept.where(F.col("arrival").isNotNull() & (F.col("reach").isNull() | (F.col("reach") < F.col("lo")))).select("arrival")


def merged(swept: DataFrame) -> DataFrame:
    """The seen ranges with the numbers in them, disjoint: producer, block, lo, hi."""
    island = F.sum(F.when(F.col("reach") >= F.col("lo") - 1, 0).otherwise(1)).over(_before().rowsBetween(Window.unboundedPreceding, 0))
    return swept.withColumn("island", island).groupBy("producer", "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _looked_up(read: DataFrame, seen_texts: DataFrame | None) -> DataFrame:
    """Arrivals to keep of messages whose identifier can't be read."""
    rest = read.where("producer is null")
    found = rest.where("exact is not null").groupBy("exact").agg(F.min("arrival").alias("arrival"))
    if seen_texts is not None:
        found = found.join(seen_texts, "exact", "left_anti")
    return found.select("arrival").unionByName(rest.where("exact is null").select("arrival"))


def accept(
    messages: DataFrame,
    producer: Column,
    number: Column,
    exact: Column,
    arrival: str,
    seen: DataFrame | None = None,
    seen_texts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, ranges): the arrivals to keep, and the merged ranges to hand to the next call.

    `messages` needs a unique `arrival`. A row with producer and number is accepted if it is the
    first of its number and `seen` doesn't cover the number. Else the row with the smallest arrival
    of each `exact` text is accepted, unless `seen_texts` (see texts) has it; a row without `exact`
    too is no message of which a copy could be told, and is always accepted. Other columns of
    `messages` are ignored; empty tables give empty results.
    """
    read = identified(messages, producer, number, exact, arrival)
    swept = _swept(read, seen)
    kept = uncovered(swept).unionByName(_looked_up(read, seen_texts))
    return kept.select(F.col("arrival").alias(arrival)), merged(swept)


PARTS = 2  # deliveries of batches in which a feed is taken in


def accept_in_parts(
    messages: DataFrame, producer: Column, number: Column, exact: Column, arrival: str, batch: str, parts: int = PARTS
) -> tuple[DataFrame, DataFrame]:
    """(accepted, ranges) of a feed taken in as it was delivered: batch after batch, `parts` deliveries of batches, ranges and texts handed on from each to the next.

    `batch` is a whole number that rises with `arrival`; rows without batch come first. A copy in a later delivery
    is told by the ranges alone, one in the same delivery by its number. The result is that of one call of `accept`.
    """
    read = identified(messages, producer, number, exact, arrival, batch)
    least, most = read.agg(F.min(batch), F.max(batch)).take(1)[0]
    step = 1 if least is None else max(1, -(-(most - least + 1) // parts))
    part = F.coalesce(F.floor((F.col(batch) - (least or 0)) / step), F.lit(0))
    seen, told, kept = None, None, []
    for i in range(parts):
        now = read.where(part == i)
        swept = stored(_swept(now, seen), "swept")
        kept.append(uncovered(swept).unionByName(_looked_up(now, told)))
        seen = merged(swept)
        told = read.where((part <= i) & F.col("producer").isNull() & F.col("exact").isNotNull()).select("exact").distinct()
    accepted = functools.reduce(DataFrame.unionByName, kept)
    return accepted.select(F.col("arrival").alias(arrival)), seen


def texts(messages: DataFrame, producer: Column, number: Column, exact: Column) -> DataFrame:
    """The texts of identifiers that can't be read, each once, to be kept for later calls of accept beside the ranges."""
    return messages.where((producer.isNull() | number.isNull()) & exact.isNotNull()).select(exact.alias("exact")).distinct()


def duplicates(messages: DataFrame, accepted: DataFrame, arrival: str) -> DataFrame:
    """Arrivals of `messages` that were not accepted; the join key is unique, so copies of one message can't pile up."""
    return messages.select(arrival).join(accepted, arrival, "left_anti")
