"""Structured Streaming queries around the batch operators, and their health."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from weirflow.operators import apply, outbox
from weirflow.plans.spec import ModelSpec
from weirflow.sources.tables import scratch, stored
from weirflow.streaming.store import SnapshotStore


def kafka_source(spark: SparkSession, servers: str, topics: list[str], group: str) -> DataFrame:
    """Messages of the topics, in the columns that the consumer reads. Needs Spark's Kafka package."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("kafka.group.id", group).load()
    return rows.select(
        "topic", F.col("partition").alias("partition_no"), F.col("offset").alias("offset_no"), F.col("timestamp").cast("timestamp_ntz").alias("received_at"),
        F.col("key").cast("string").alias("message_key"), F.col("value").cast("string").alias("message_value"),
    )


def file_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Message files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def topic_sink(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Messages in one folder per topic, which readers prune by."""
    messages.write.mode(mode).partitionBy("topic").parquet(path)


def consume(
    source: DataFrame,
    store: SnapshotStore,
    models: list[ModelSpec],
    order: list[str],
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    filters: list[tuple[str, Column]] | None = None,
    retries: int = 0,
    dedupe: bool = False,
) -> StreamingQuery:
    """Apply every micro-batch of messages to the store's state, feed and rejects; ends when what is there is done.

    `transform` sees the batch first; with `dedupe` repeated messages are removed before it where that may
    be done (see apply.deduplicated). A batch is committed whole or not at all, under its id, so a
    replayed one changes nothing twice; one that fails is tried again `retries` times, then the query
    fails and a restart takes it up.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number <= store.last_batch:
            return
        for left in range(retries, -1, -1):
            try:
                with scratch(batch.sparkSession):
                    rows = batch
                    if dedupe:
                        rows = apply.deduplicated(batch.withColumn("__batch", F.lit(number)), ["__batch"], order).drop("__batch")
                        rows = rows.drop(order[-1]).withColumnRenamed("first_arrival", order[-1])
                    rows = transform(rows) if transform else rows
                    state, feed, rejects = apply.consume(rows, order, models, store.read("state"), filters)
                    store.commit(number, {"state": state}, {"feed": feed, "rejects": rejects})
                return
            except Exception:
                if not left:
                    raise

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Gate(StatefulProcessor):
    """Latest applied time of a key; rows of a batch come in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", "updated bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self._latest.get()[0] if self._latest.exists() else None
        # One micro-batch's rows of one key; the trigger bounds them.
        batch = pd.concat(list(rows)).sort_values("arrival")
        accepted = []
        for created, updated in zip(batch["created"], batch["updated"]):
            at = updated if not pd.isna(updated) else created
            accepted.append(latest is None or pd.isna(at) or at >= latest)
            if accepted[-1] and not pd.isna(updated):
                latest = int(updated)
        if latest is not None:
            self._latest.update((latest,))
        yield pd.DataFrame({"key": batch["key"], "arrival": batch["arrival"], "accepted": accepted})

    def close(self) -> None:
        pass


def gated(rows: DataFrame) -> DataFrame:
    """A stream (key, arrival, created, updated; whole numbers) with `accepted` by the last-writer-wins gate.

    State is one number per key, in RocksDB; the session needs that state store provider.
    """
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Gate(), outputStructType="key bigint, arrival bigint, accepted boolean", outputMode="Append", timeMode="None"
    )


def poll(
    read: Callable[[], DataFrame], publish: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], clock: Callable[[], Column],
    sleep_s: float = 0.2, rounds: int | None = None, batch: int = outbox.BATCH, dedupe: bool = False, delay_s: float = 0,
) -> int:
    """The outbox worker: read what is due of every topic, publish it, settle it, sleep; the number of rows handled.

    `publish` returns the failed rows (id, error_class, error_message); `write` gets the settled batch and must
    have written it when it returns. Both see the same stored rows, which are removed afterwards.
    One worker per outbox; the single writer takes the place of a lock per topic.
    """
    handled, done = 0, 0
    while rounds is None or done < rounds:
        now = clock()
        found = outbox.first_per_topic(outbox.publishable(read(), now, delay_s), batch).drop("rank")
        with scratch(found.sparkSession):
            # Rows that come in meanwhile must not take the place of those that are published.
            due = stored(found, "due")
            n = due.count()
            if n:
                failed = stored(publish(outbox.consecutive_dedupe(due, ["created_at", "id"]) if dedupe else due), "failed")
                write(outbox.settle(due, failed, now))
        handled += n
        done += 1
        time.sleep(sleep_s)
    return handled


class Heartbeat(StreamingQueryListener):
    """Touches a file whenever a query makes progress, and removes it when one ends."""

    def __init__(self, path: str):
        self.path = path

    def _touch(self) -> None:
        with open(self.path, "a"):
            os.utime(self.path)

    def onQueryStarted(self, event) -> None:
        self._touch()

    def onQueryProgress(self, event) -> None:
        self._touch()

    def onQueryIdle(self, event) -> None:
        self._touch()

    def onQueryTerminated(self, event) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def healthy(path: str, ttl_s: float = 600) -> bool:
    """Whether the heartbeat file was touched within the time given."""
    return os.path.exists(path) and time.time() - os.path.getmtime(path) <= ttl_s
