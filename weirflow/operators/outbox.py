"""The outbox: rows per topic, what is due, and what happened to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import naming, wire
from weirflow.operators.scan import running
from weirflow.plans.spec import OBSERVER_TOPIC, Registry

BATCH = 100  # rows per topic that one poll takes
BACKOFF_S = 5  # seconds, doubled with every attempt
DAY_US = 86_400_000_000


def insert(changes: DataFrame, registry: Registry, now: Column, enabled: bool = True) -> DataFrame:
    """Outbox rows of changes (model, id, kind, partition_key, changeset): one per target topic, none for models that nobody needs.

    Only the observers' row keeps the changeset. With `enabled` off there are no rows.
    """
    topics = {m: registry.outbox_topics(m) for m in registry.models}
    target = F.coalesce(*(F.when(F.col("model") == m, F.array(*map(F.lit, t))) for m, t in topics.items() if t))
    resource = F.coalesce(*(F.when(F.col("model") == m, F.lit(s.resource)) for m, s in registry.models.items()))
    rows = changes.where(F.lit(enabled)).withColumn("topic", F.explode(target))
    return rows.select(
        F.col("model").alias("resource_class"),
        F.col("id").cast("string").alias("resource_id"),
        naming.event_name(resource, F.col("kind")).alias("event_name"),
        "topic",
        "partition_key",
        F.when(F.col("topic") == OBSERVER_TOPIC, F.col("changeset")).alias("changeset"),
        F.lit(0).alias("attempts"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def pending_topics(outbox: DataFrame) -> DataFrame:
    return outbox.where(F.col("published_at").isNull()).select("topic").distinct()


def published_since(outbox: DataFrame, moment: Column) -> DataFrame:
    return outbox.where(F.col("published_at") >= moment)


def publishable(outbox: DataFrame, now: Column, delay_s: float = 0, pinned_delay: bool = False) -> DataFrame:
    """Unpublished rows whose retry is due, and with a delay those that have waited for it.

    `pinned_delay` lets rows through up to `now` plus the delay, as deployed outboxes are known to do.
    """
    due = outbox.where(F.col("published_at").isNull() & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))
    if delay_s > 0:
        wait = F.make_dt_interval(secs=F.lit(delay_s))
        due = due.where(F.col("created_at") <= (now + wait if pinned_delay else now - wait))
    return due


def first_per_topic(due: DataFrame, k: int = BATCH, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The k oldest rows of every topic. The rank limit is pushed below the shuffle, so a topic sends k rows per task at most."""
    w = Window.partitionBy("topic").orderBy(*order)
    return due.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_resource_age(rows: DataFrame, resources: DataFrame) -> DataFrame:
    """Rows with `age_at`, the creation time of their resource (resource_class, resource_id, resource_created_at), else their own."""
    return rows.join(resources, ["resource_class", "resource_id"], "left").withColumn("age_at", F.coalesce("resource_created_at", "created_at")).drop("resource_created_at")


RUN_KEY = ("resource_class", "resource_id", "event_name", "topic")


def consecutive_dedupe(rows: DataFrame, order: list[str], key: tuple[str, ...] = RUN_KEY, group: str = "topic", block: Column | None = None) -> DataFrame:
    """The last row of every run of equal neighbours; equal rows with others between them stay.

    `order` must be total. A row is dropped if the next one in its group has the same key. The next
    row is found block by block, so a group with most of the rows is spread over many tasks.
    """
    same = F.struct(*(F.col(c) for c in key))
    blocks = F.floor(wire.us_of(F.col(order[0])) / DAY_US) if block is None else block
    rows = rows.withColumn("__block", blocks).withColumn("__state", F.struct(*order, same.alias("key")))
    ahead = running(rows, [group], "__block", order, "__state", "__next", combine=F.min, backwards=True, inclusive=False)
    return ahead.where(~F.coalesce(same.eqNullSafe(F.col("__next.key")), F.lit(False))).drop("__block", "__state", "__next")


def backoff_s(attempts: Column, base: float = BACKOFF_S) -> Column:
    """Seconds to wait before the retry that follows so many attempts."""
    return (F.lit(base) * F.pow(F.lit(2.0), attempts)).cast("double")


def mark_published(rows: DataFrame, now: Column) -> DataFrame:
    """Rows as published now; what is known of failures is cleared, attempts stay."""
    cleared = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("error_class", "error_message", "failed_at", "retry_at") if c in rows.columns}
    return rows.withColumns({**cleared, "published_at": now})


def mark_failed(rows: DataFrame, now: Column, error_class: Column, error_message: Column) -> DataFrame:
    """Rows with one more attempt and a retry time; no attempts yet counts as none."""
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    return rows.withColumns(
        {
            "attempts": attempts,
            "failed_at": now,
            "retry_at": now + F.make_dt_interval(secs=backoff_s(attempts)),
            "error_class": error_class,
            "error_message": error_message,
        }
    )


def settle(batch: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """A batch after publishing: rows of `failed` (id, error_class, error_message) are marked failed, all others published.

    With consecutive duplicates removed before publishing, only the row that stood for its run fails;
    those dropped in its favour count as published.
    """
    errors = failed.select("id", F.col("error_class").alias("__class"), F.col("error_message").alias("__message"), F.lit(True).alias("__failed"))
    joined = batch.join(errors, "id", "left")
    bad = mark_failed(joined.where("__failed"), now, F.col("__class"), F.col("__message"))
    good = mark_published(joined.where("__failed is null"), now)
    return good.unionByName(bad).drop("__class", "__message", "__failed")


def error_text(error_class: Column, error_message: Column) -> Column:
    """The error as one text; empty texts count as none."""
    text = lambda c: F.when(F.length(c) > 0, c)
    return F.nullif(F.concat_ws(": ", text(error_class), text(error_message)), F.lit(""))


def latency_s() -> Column:
    """Seconds from creation to publishing."""
    return (wire.us_of(F.col("published_at")) - wire.us_of(F.col("created_at"))) / 1e6


def latency(outbox: DataFrame, now: Column, interval_s: float = 60) -> DataFrame:
    """One row: min_s, max_s, avg_s over rows published in the last interval, and oldest_s, the age of the oldest pending row; 0 where there are none."""
    since = now - F.make_dt_interval(secs=F.lit(interval_s))
    recent = F.when((F.col("published_at") >= since) & (F.col("published_at") <= now), latency_s())
    waiting = F.when(F.col("published_at").isNull(), wire.us_of(now) - wire.us_of(F.col("created_at"))) / 1e6
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return outbox.agg(
        zero(F.min(recent)).alias("min_s"), zero(F.max(recent)).alias("max_s"), zero(F.avg(recent)).alias("avg_s"), zero(F.max(waiting)).alias("oldest_s")
    )


def latency_by_minute(outbox: DataFrame, width: str = "1 minute") -> DataFrame:
    """The latencies reported for every tumbling interval and topic in which something was published."""
    done = outbox.where(F.col("published_at").isNotNull())
    return (
        done.groupBy("topic", F.window("published_at", width).alias("w"))
        .agg(F.min(latency_s()).alias("min_s"), F.max(latency_s()).alias("max_s"), F.avg(latency_s()).alias("avg_s"), F.count("*").alias("published"))
        .select("topic", F.col("w.start").alias("minute"), "min_s", "max_s", "avg_s", "published")
    )
