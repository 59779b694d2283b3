from __future__ import annotations

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from weirflow.operators import apply, outbox
from weirflow.plans.spec import ModelSpec
from weirflow.streaming import runners
from weirflow.streaming.store import SnapshotStore

SCHEMA = "n bigint, received_at timestamp_ntz, message_value string"
MODELS = [ModelSpec("Rental")]


def _messages():
    found = []
    for i in range(30):
        record = {"id": i % 4, "name": f"v{i}", "updated_at": f"2025-01-01T00:00:{(i * 7) % 60:02}Z", "links": {}}
        found.append((i, dt.datetime(2025, 1, 1), json.dumps({"message": [{"event": "rental_updated", "model_name": "Rental", "data": [record]}]})))
    return found


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame(_messages()[part * 10 : part * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their times
    store = SnapshotStore(spark, str(tmp_path / "store"))
    source = runners.file_source(spark, str(tmp_path / "in"), SCHEMA)
    runners.consume(source, store, MODELS, ["n"], str(tmp_path / "checkpoint")).awaitTermination(120)
    state, feed, _ = apply.consume(spark.createDataFrame(_messages(), SCHEMA), ["n"], MODELS)
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert store.last_batch == 2
    assert pick(store.read("state"), "synced_id", "updated_us", "synced_data") == pick(state, "synced_id", "updated_us", "synced_data")
    assert pick(store.read("feed"), "place", "accepted", "changes") == pick(feed, "place", "accepted", "changes")
    assert store.read("rejects").count() == 0
    # a batch that comes again changes nothing
    store.commit(1, {"state": state.limit(0)})
    assert store.read("state").count() == 4


def test_stream_removes_repeated_messages(spark, tmp_path):
    spark.createDataFrame(_messages(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    source = runners.file_source(spark, str(tmp_path / "in"), SCHEMA)
    runners.consume(source, store, MODELS, ["n"], str(tmp_path / "checkpoint"), dedupe=True).awaitTermination(120)
    state, _, _ = apply.consume(spark.createDataFrame(_messages(), SCHEMA), ["n"], MODELS)
    pick = lambda df: sorted(map(tuple, df.select("synced_id", "updated_us", "synced_data").collect()))
    assert pick(store.read("state")) == pick(state) and store.read("feed").count() == 4


def test_stateful_gate_gives_what_the_window_gives(spark, tmp_path):
    data = [(i % 5, i, None if i % 7 else i, None if i % 3 == 0 else (i * 37) % 50) for i in range(120)]
    schema = "key bigint, arrival bigint, created bigint, updated bigint"
    for part in range(2):
        spark.createDataFrame(data[part * 60 : part * 60 + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = runners.gated(runners.file_source(spark, str(tmp_path / "in"), schema))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {r.arrival: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = apply.gate(spark.createDataFrame(data, schema), ["key"], "created", "updated", "arrival")
    assert got == {r.arrival: r.accepted for r in want.collect()}


def test_poll_settles_batches(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    schema = "id bigint, topic string, resource_class string, resource_id string, event_name string, created_at timestamp_ntz, published_at timestamp_ntz, retry_at timestamp_ntz, failed_at timestamp_ntz, attempts int, error_class string, error_message string"
    rows = [(i, "t", "Rental", "1", "rental_updated" if i < 3 else f"e{i}", base, None, None, None, 0, None, None) for i in range(6)]
    box = {r[0]: r for r in rows}
    sent = []

    def publish(batch):
        ids = [r.id for r in batch.orderBy("id").collect()]
        sent.append(ids)
        return spark.createDataFrame([(i, "Boom", "x") for i in ids if i == 4], "id bigint, error_class string, error_message string")

    def write(settled):
        for r in settled.collect():
            box[r.id] = tuple(r[c.split()[0]] for c in schema.split(", "))

    clock = iter([base, base + dt.timedelta(seconds=5), base + dt.timedelta(seconds=10)])
    runners.poll(lambda: spark.createDataFrame(list(box.values()), schema), publish, write, lambda: F.lit(next(clock)).cast("timestamp_ntz"), sleep_s=0, rounds=3, dedupe=True)
    assert sent == [[2, 3, 4, 5], [4]]
    assert box[4][9] == 2 and all(box[i][6] is not None for i in (0, 1, 2, 3, 5))


def test_topic_sink_and_heartbeat(spark, tmp_path):
    runners.topic_sink(spark.createDataFrame([("a", "1"), ("b", "2")], "topic string, value string"), str(tmp_path / "out"))
    assert sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("topic=")) == ["topic=a", "topic=b"]
    beat = runners.Heartbeat(str(tmp_path / "alive"))
    assert not runners.healthy(beat.path)
    beat.onQueryProgress(None)
    assert runners.healthy(beat.path)
    os.utime(beat.path, (0, 0))
    assert not runners.healthy(beat.path)
    beat.onQueryTerminated(None)
    assert not os.path.exists(beat.path)
    assert outbox.BATCH == 100
