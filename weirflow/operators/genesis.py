"""Replay of a table's records on a schedule."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import naming
from weirflow.operators.scan import positions
from weirflow.plans.spec import Registry, Topic

BATCH = 1000
SAFETY_DELAY_S = 60


def scan(
    table: DataFrame,
    updated: str = "updated_at",
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    soft_delete: str | None = None,
    visible_only: bool = False,
    where: dict[str, Any] | None = None,
) -> DataFrame:
    """Rows to replay. All filters are plain comparisons that reach the scan.

    The time range holds, both ends included, only if both ends are given. Visible rows are those
    without soft-delete stamp, if the table has that column. Conditions are joined by AND: a list
    means any of its values, None means null.
    """
    if start is not None and end is not None:
        table = table.where(F.col(updated).between(F.lit(start), F.lit(end)))
    if visible_only and soft_delete in table.columns:
        table = table.where(F.col(soft_delete).isNull())
    for column, value in (where or {}).items():
        c = F.col(column)
        table = table.where(c.isNull() if value is None else c.isin(*value) if isinstance(value, (list, tuple, set)) else c == value)
    return table


def kind(soft_delete: Column | None) -> Column:
    """Replayed records are updated, soft-deleted ones destroyed."""
    return F.lit("updated") if soft_delete is None else F.when(soft_delete.isNotNull(), "destroyed").otherwise("updated")


def schedule(total: int, days: float, batch: int = BATCH) -> tuple[int, int]:
    """(number of batches, seconds between two of them)."""
    batches = math.ceil(total / batch)
    return batches, math.floor(86_400 * days / batches) if batches else 0


def batched(rows: DataFrame, key: str, days: float, batch: int = BATCH, spread: int = 1 << 20) -> DataFrame:
    """Replay jobs: batch_no, ids (sorted), delay_s after the start. `spread`: rows that are numbered in one task, about; rows without key are left out."""
    rows = rows.where(F.col(key).isNotNull()).select(key)
    total = rows.count()
    _, every = schedule(total, days, batch)
    return (
        positions(rows, [key], "n", math.ceil(total / spread))
        .groupBy(F.floor(F.col("n") / batch).alias("batch_no"))
        .agg(F.array_sort(F.collect_list(key)).alias("ids"))
        .withColumn("delay_s", F.col("batch_no") * every)
    )


def rescan(table: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Rows of the table that the jobs name; a semi join, so an id named twice gives its row once."""
    return table.join(jobs.select(F.explode("ids").alias(key)), key, "left_semi")


def rescan_by_job(table: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Rows of the table that each job names, with its batch_no; an id named twice in a job gives its row once there."""
    return table.join(jobs.select("batch_no", F.explode(F.array_distinct("ids")).alias(key)), key)


def performed(model: str, service: str, topic: str, now: dt.datetime, days: float) -> dict[str, Any]:
    """The control record of a replay."""
    return {"model": model, "service": service, "topic": topic, "start_at": now, "end_at": now + dt.timedelta(days=days, seconds=SAFETY_DELAY_S)}


def replay_topic(topic: str) -> tuple[str, bool]:
    """(topic without the replica's ending, whether only the replica is meant)."""
    ending = naming.topic_name("", "", replica=True)[1:]
    return (topic.removesuffix(ending), True) if topic.endswith(ending) else (topic, False)


def replay(table: DataFrame, registry: Registry, topic: Topic, model: str, genesis_only: bool = False, **conditions: Any) -> DataFrame:
    """Records of a model to be published again in a topic: the rows of `scan` with event_name and topic, once for the topic and once for its replica, or for that alone.

    A model that the topic doesn't publish itself, or a replica that it doesn't have, is an error.
    """
    registry.check_replay(topic, model, genesis_only)
    spec = registry.models[model]
    rows = scan(table, soft_delete=spec.soft_delete_column, **conditions)
    gone = F.col(spec.soft_delete_column) if spec.soft_delete_column in rows.columns else None
    names = ([] if genesis_only else [topic.full_name]) + ([topic.replica_name] if topic.genesis_replica else [])
    return rows.withColumns({"event_name": naming.event_name(spec.resource, kind(gone)), "topic": F.explode(F.array(*map(F.lit, names)))})
