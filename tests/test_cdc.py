"""CDC operators: golden cases and equivalence with sequential runs."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weirflow.functions import naming
from weirflow.operators import apply, classify, decode, fanout, genesis, outbox, snapshot
from weirflow.plans import cdc
from weirflow.plans.spec import OBSERVER_TOPIC, ModelSpec, Observation, Publication, Registry, Relation, SpecError, Topic

NOW = dt.datetime(2025, 1, 1, 12)


def ago(s):
    return NOW - dt.timedelta(seconds=s)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- names


@pytest.mark.parametrize("many,one", [("taxes", "tax"), ("bookings_fees", "bookings_fee"), ("categories", "category"), ("bookings", "booking"), ("status", "status"), ("branches", "branch")])
def test_inflection(spark, many, one):
    assert naming.singular(many) == one and naming.plural(one) == many
    assert spark.range(1).select(decode.singular(F.lit(many))).collect()[0][0] == one


@pytest.mark.parametrize("many,one", [("movies", "movie"), ("statuses", "status"), ("buses", "bus"), ("series", "series"), ("people", "person"), ("analyses", "analysis"), ("rental_addresses", "rental_address"), ("ties", "tie"), ("as", "a"), ("house_wives", "house_wife"), ("news", "news")])
def test_inflection_of_uncommon_forms(spark, many, one):
    assert naming.singular(many) == one
    assert spark.range(1).select(decode.singular(F.lit(many))).collect()[0][0] == one
    assert naming.plural(one) == many or one.endswith("s")


def test_names(spark):
    assert naming.classify("bookings_fee") == "BookingsFee" and naming.underscore("BookingsFee") == "bookings_fee"
    assert naming.topic_name("v3", "rentals", replica=True) == "v3_rentals_genesis"
    df = spark.createDataFrame([("12",), ("x",), (None,), ("7.9",)], "k string")
    assert [r[0] for r in df.select(naming.partition_key(F.col("k"))).collect()] == ["12", "0", "0", "0"]


# --- registry


def registry(**changes):
    models = {m: ModelSpec(m) for m in ("Rental", "Tax", "Account", "Client")}
    models["Rental"] = ModelSpec("Rental", relations=(Relation("taxes", "Tax", "rental_id", many=True),))
    topics = (
        Topic("v3", "rentals", (Publication("Rental", ("taxes",), (Observation("Account", ("name",), "rentals"), Observation("Account", ("id",), "x"))),), genesis_replica=True),
        Topic("v3", "accounts", (Publication("Account"),)),
    )
    return Registry(models, changes.get("topics", topics))


def test_registry_routes():
    r = registry()
    assert r.outbox_topics("Rental") == ["v3_rentals"] and r.outbox_topics("Tax") == ["v3_rentals"]
    assert r.outbox_topics("Account") == ["v3_accounts", OBSERVER_TOPIC] and r.outbox_topics("Client") == []
    assert [o.path for _, _, o in r.observations_of("Account")] == ["rentals"]
    assert r.mapping()[0] == ("v3", "v3_rentals", "Rental", ["Tax"])
    assert r.missing_columns({"Account": ["name"]}) == ["Account.id"]


def test_registry_rejects():
    r = registry()
    with pytest.raises(SpecError):
        r.check_replay(r.topics[0], "Tax")
    with pytest.raises(SpecError):
        r.check_replay(r.topics[1], "Account", genesis_only=True)
    r.check_replay(r.topics[0], "Rental", genesis_only=True)
    with pytest.raises(SpecError):
        registry(topics=(Topic("v3", "x", (Publication("Nobody"),)),))
    with pytest.raises(SpecError):
        registry(topics=(Topic("v3", "x", (Publication("Rental", ("wheels",)),)),))
    with pytest.raises(SpecError):
        registry(topics=(Topic("v3", "x", (Publication("Rental", (), (Observation("Account", (), "p"),)),)),))


def test_registry_dim(spark):
    assert sorted(registry().dim(spark).select("topic", "model", "kind").collect())[:2] == [("v3_accounts", "Account", "publishes"), ("v3_rentals", "Account", "observes")]


# --- changes


def test_transitions(spark):
    # (old stamp, new stamp, first): what is published, and with updates after a soft delete
    cases = [((None, None, True), "created", "created"), ((None, None, False), "updated", "updated"), ((None, "t", False), "destroyed", "destroyed"), (("t", "u", False), "destroyed", "destroyed"), (("t", None, False), "created", "created"), (("t", "t", False), None, "updated")]
    df = spark.createDataFrame([c for c, _, _ in cases], "o string, n string, f boolean")
    args = F.col("o"), F.col("n"), F.col("f")
    got = df.select(classify.transition(*args), classify.transition(*args, after_soft_delete=True), classify.transition(*args, is_last_destroy=F.lit(True))).collect()
    assert [tuple(r) for r in got] == [(a, b, "destroyed") for _, a, b in cases]


def test_changesets(spark):
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, "a", None), (1, 3, "b", 5), (1, 4, None, 5)], "id int, n int, name string, size int")
    seen = classify.with_previous(log, ["id"], ["n"], ["name", "size"])
    blocks = classify.with_previous(log, ["id"], ["n"], ["name", "size"], block=F.floor(F.col("n") / 2))
    assert sorted(blocks.select(seen.columns).collect(), key=str) == sorted(seen.collect(), key=str)
    assert [r.n for r in seen.where(classify.changed(["name", "size"])).orderBy("n").collect()] == [1, 3, 4]
    long = {(r.n, r.attr): (r.old, r.new) for r in classify.long_changes(seen, ["n"], ["name", "size"]).collect()}
    assert long == {(1, "name"): (None, "a"), (3, "name"): ("a", "b"), (3, "size"): (None, "5"), (4, "name"): ("b", None)}
    sets = {r.n: set(r.c) for r in seen.select("n", classify.changeset(["name", "size"]).alias("c")).collect()}
    assert sets == {1: {"name"}, 2: set(), 3: {"name", "size"}, 4: {"name"}}
    gone = log.limit(1).select(classify.destroyed_changeset("id", "n")).collect()[0][0]
    assert gone["id"]["old"] == "1" and gone["id"]["new"] is None
    key = F.lit("0123456789abcdef")
    texts = spark.createDataFrame([("x",), (None,)], "t string").withColumn("c", classify.encrypted(F.col("t"), key))
    assert [r[0] for r in texts.select(classify.decrypted(F.col("c"), key)).collect()] == ["x", "{}"]


# --- outbox


def test_insert_fans_out(spark):
    changes = spark.createDataFrame([("Account", 1, "updated", "7", '{"name":["a","b"]}'), ("Client", 2, "created", "7", "{}"), ("Tax", 3, "destroyed", None, "{}")], "model string, id bigint, kind string, partition_key string, changeset string")
    got = sorted((r.topic, r.event_name, r.resource_id, r.changeset) for r in outbox.insert(changes, registry(), now()).collect())
    assert got == [("__outbox_observer__", "account_updated", "1", '{"name":["a","b"]}'), ("v3_accounts", "account_updated", "1", None), ("v3_rentals", "tax_destroyed", "3", None)]
    assert outbox.insert(changes, registry(), now(), enabled=False).count() == 0


def test_consecutive_dedupe_keeps_the_last_of_each_run(spark):
    kinds = "a b b c b b b d a".split()
    data = [(i, ago(100 - i // 2), "Rental", "1", k, "t") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(data, "id bigint, created_at timestamp_ntz, resource_class string, resource_id string, event_name string, topic string")
    got = sorted(r.id for r in outbox.consecutive_dedupe(df, ["created_at", "id"]).collect())
    assert got == [0, 2, 3, 6, 7, 8]
    blocks = outbox.consecutive_dedupe(df, ["created_at", "id"], block=F.floor(F.col("id") / 2))
    assert sorted(r.id for r in blocks.collect()) == got


ROW = "id bigint, topic string, created_at timestamp_ntz, published_at timestamp_ntz, retry_at timestamp_ntz, failed_at timestamp_ntz, attempts int, error_class string, error_message string"


def test_publishable_and_batches(spark):
    data = [(1, "a", ago(4), None, None, None, 0, None, None), (2, "a", ago(9), None, ago(1), None, 1, "E", "m"), (3, "a", ago(8), None, ago(-1), None, 1, "E", "m"), (4, "a", ago(99), ago(50), None, None, 0, None, None), (5, "b", ago(6), None, None, None, None, None, None)]
    df = spark.createDataFrame(data, ROW)
    due = lambda **k: sorted(r.id for r in outbox.publishable(df, now(), **k).collect())
    assert due() == [1, 2, 5] and due(delay_s=5) == [2, 5] and due(delay_s=5, pinned_delay=True) == [1, 2, 5]
    assert sorted((r.id, r["rank"]) for r in outbox.first_per_topic(outbox.publishable(df, now()), 1).collect()) == [(2, 1), (5, 1)]
    assert sorted(r.topic for r in outbox.pending_topics(df).collect()) == ["a", "b"]
    failed = spark.createDataFrame([(5, "Boom", "")], "id bigint, error_class string, error_message string")
    settled = {r.id: r for r in outbox.settle(outbox.publishable(df, now()), failed, now()).collect()}
    assert settled[5].attempts == 1 and settled[5].retry_at == NOW + dt.timedelta(seconds=10) and settled[5].published_at is None
    assert settled[2].published_at == NOW and settled[2].attempts == 1 and settled[2].error_class is None and settled[2].retry_at is None


def test_latency(spark):
    data = [(1, "a", ago(11), ago(10), None, None, 0, None, None), (2, "a", ago(13), ago(10), None, None, 0, None, None), (3, "a", ago(900), ago(120), None, None, 0, None, None), (4, "a", ago(121), None, None, None, 0, None, None)]
    df = spark.createDataFrame(data, ROW)
    assert tuple(outbox.latency(df, now()).collect()[0]) == (1, 3, 2, 121)
    assert tuple(outbox.latency(df.limit(0), now()).collect()[0]) == (0, 0, 0, 0)
    errors = spark.createDataFrame([("E", "m"), ("E", ""), ("", None), (None, "m")], "a string, b string")
    assert [r[0] for r in errors.select(outbox.error_text(F.col("a"), F.col("b"))).collect()] == ["E: m", "E", None, "m"]


# --- messages


def test_aggregate_keeps_roots_and_null_fields(spark):
    spec = ModelSpec("Rental", ("name", "size"), (Relation("account", "Account", "account_id"), Relation("taxes", "Tax", "rental_id", many=True)), computed={"size": lambda df: F.length("name")})
    roots = spark.createDataFrame([(1, "ab", 7), (2, None, None)], "id bigint, name string, account_id bigint")
    taxes = spark.createDataFrame([(12, 1), (11, 1), (13, None)], "id bigint, rental_id bigint")
    accounts = spark.createDataFrame([(7, "x")], "id bigint, name string")
    found = snapshot.aggregate(roots, spec, {"taxes": (taxes, ModelSpec("Tax")), "account": (accounts, ModelSpec("Account", ("name",)))}, ("taxes", "account"))
    got = {r.key: json.loads(r.j) for r in found.select("key", snapshot.to_json(F.col("record")).alias("j")).collect()}
    assert got[1] == {"id": 1, "name": "ab", "size": 2, "links": {"account": 7, "taxes": [11, 12]}, "taxes": [{"id": 11}, {"id": 12}], "account": {"id": 7, "name": "x"}}
    assert got[2] == {"id": 2, "name": None, "size": None, "links": {"account": None, "taxes": []}, "taxes": [], "account": None}
    assert [json.loads(r.record) for r in snapshot.raw(accounts).collect()] == [{"id": 7, "name": "x"}]
    assert json.loads(spark.range(1).select(snapshot.deleted(F.lit('a"b'))).collect()[0][0]) == {"id": 'a"b', "links": {}}


def test_routing(spark):
    topic = registry().topics[0]
    rows = spark.createDataFrame([("Rental:1", "7", "{}")], "key string, partition_key string, value string")
    assert sorted(r.topic for r in snapshot.routed(rows, topic).collect()) == ["v3_rentals", "v3_rentals_genesis"]
    assert [r.topic for r in snapshot.routed(rows, topic, genesis_only=True).collect()] == ["v3_rentals_genesis"]
    df = spark.createDataFrame([(5, None)], "account_id bigint, x string")
    keys = df.select(snapshot.partition_key(df, topic), snapshot.partition_key(df, Topic("v3", "t", partition_key="x")), snapshot.partition_key(df, Topic("v3", "t", partition_key=lambda d: d.account_id * 2)), snapshot.partition_key(df, topic, default="nowhere"))
    assert tuple(keys.collect()[0]) == ("5", "0", "10", None)
    groups = spark.createDataFrame([(1, [([1],)]), (2, [([1],), ([],)]), (3, [])], "k int, events array<struct<records:array<int>>>")
    assert [r.k for r in snapshot.publishable(groups).collect()] == [1]
    tomb = spark.createDataFrame([(None,), (" null ",), ("{}",)], "v string")
    assert [r[0] for r in tomb.select(snapshot.is_tombstone(F.col("v"))).collect()] == [True, True, False]


def test_fanout(spark):
    changes = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "c bigint, parent_id bigint")
    parents = spark.createDataFrame([(10, "p"), (11, "q")], "id bigint, n string")
    assert fanout.parents(changes, "parent_id", parents, "id").count() == 1
    assert fanout.parents(changes, "parent_id", parents, "id", distinct=False).count() == 2
    routes = fanout.route(spark.createDataFrame([("x",)] * 3 + [("y",)] * 2, "c string"), ["c"], limit=2).collect()
    assert {r.c: r.route for r in routes} == {"x": "replay", "y": "inline"}


def test_genesis(spark):
    data = [(i, ago(i * 86_400), None if i % 2 else ago(1), "abc"[i % 3] if i else None) for i in range(6)]
    df = spark.createDataFrame(data, "id bigint, updated_at timestamp_ntz, canceled_at timestamp_ntz, kind string")
    ids = lambda **k: sorted(r.id for r in genesis.scan(df, **k).collect())
    assert ids() == list(range(6)) and ids(start=ago(4 * 86_400), end=ago(2 * 86_400)) == [2, 3, 4] and ids(start=NOW) == list(range(6))
    assert ids(visible_only=True, soft_delete="canceled_at") == [1, 3, 5] and ids(visible_only=True, soft_delete="other") == list(range(6))
    assert ids(where={"kind": None}) == [0] and ids(where={"kind": ["a", "b"], "id": 3}) == [3]
    assert genesis.schedule(123_456, 10_000 / 86_400) == (124, 80) and genesis.schedule(0, 1) == (0, 0)
    jobs = genesis.batched(spark.range(25).withColumn("id", F.col("id") * 3), "id", 1, batch=10, spread=7).orderBy("batch_no").collect()
    assert [(r.batch_no, r.ids, r.delay_s) for r in jobs] == [(b, [3 * i for i in range(10 * b, min(25, 10 * b + 10))], b * 28_800) for b in range(3)]
    assert genesis.rescan(spark.range(30), spark.createDataFrame([(0, [1, 1, 2])], "batch_no int, ids array<bigint>"), "id").count() == 2
    assert genesis.replay_topic("v3_rentals_genesis") == ("v3_rentals", True) and genesis.replay_topic("v3_rentals") == ("v3_rentals", False)
    assert genesis.performed("Rental", "s", "t", NOW, 0.5)["end_at"] == NOW + dt.timedelta(hours=12, seconds=60)


# --- consumer


def test_canonical_record(spark):
    record = {
        "id": 1, "name": "House", "created_at": "2020-01-01 12:00:00", "canceled_at": None, "synced_fee_id": "own", "comments": [{"content": "c"}],
        "links": {"account": 2, "fee": 10, "bookings": [3, 4], "rental": None, "taxes": [], "clients": [20], "bookable": {"type": "Property", "id": 123}, "empty": {}},
        "fee": {"id": 10, "links": {"rentals_fee": 101}, "rentals_fee": {"id": 101}}, "bookable": {"id": 123, "links": {}}, "clients": [{"id": 20}],
    }
    df = spark.createDataFrame([(json.dumps(record),)], "r string").select(F.parse_json("r").alias("record"))
    found = decode.canonical(df)
    got = json.loads(found.select(F.to_json("attributes", {"ignoreNullFields": "false"})).collect()[0][0])
    assert got == {
        "synced_id": 1, "name": "House", "synced_created_at": "2020-01-01 12:00:00", "synced_canceled_at": None, "comments": [{"content": "c"}], "synced_account_id": 2, "synced_fee_id": "own",
        "synced_booking_ids": [3, 4], "synced_rental_id": None, "synced_tax_ids": [], "synced_client_ids": [20], "synced_bookable_id": 123, "synced_bookable_type": "Property", "synced_empty_id": None, "synced_empty_type": None,
    }
    row = found.collect()[0]
    assert {r.name: None if r.records is None else len(r.records) for r in row.has_many} == {"bookings": None, "taxes": None, "clients": 1}
    assert {r.name: r.record is not None for r in row.has_one} == {"account": False, "fee": True, "rental": False, "Property": True, "empty": False}
    inner = decode.children(found, []).select("name", "to_many", "record")
    assert sorted((r.name, r.to_many) for r in inner.collect()) == [("Property", False), ("clients", True), ("fee", False)]


def test_dedupe_latest_golden(spark):
    data = [(1, "c", 16, None), (2, "u", 16, 415), (3, "u", 17, 416), (4, "u", 16, 417), (5, "d", 16, None), (6, "u", 16, 412), (7, "x", 1, 5), (8, "x", 1, 5), (9, "y", 1, None), (10, "y", 1, None), (11, "y", 1, 999)]
    df = spark.createDataFrame(data, "n bigint, event string, id bigint, t bigint")
    got = sorted((r.first_arrival, r.n) for r in apply.dedupe_latest(df, ["event", "id"], "t", "n").collect())
    assert got == [(1, 1), (2, 4), (3, 3), (5, 5), (7, 7), (9, 10)]


def test_dedupe_applies(spark):
    one, two = {"data": [{"id": 1}]}, {"data": [{"id": 1}, {"id": 2}]}
    batches = {"yes": [{"message": [one]}, {"message": [{"data": {"id": 3}}]}], "items": [{"message": [one]}, {"message": [two]}], "events": [{"message": [one, one]}], "tombstone": [{"message": [one]}, None]}
    data = [(b, json.dumps(m) if m else None) for b, ms in batches.items() for m in ms]
    got = {r.b: r.applies for r in apply.dedupe_applies(spark.createDataFrame(data, "b string, message_value string"), ["b"]).collect()}
    assert got == {"yes": True, "items": False, "events": False, "tombstone": False}


def test_gate_matches_a_sequential_fold(spark):
    rng = random.Random(13)
    data = [(n, rng.randrange(8), rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(50), rng.randrange(50)])) for n in range(500)]
    stored, want = {0: 30, 1: None}, {}
    latest = dict(stored)
    for n, k, c, u in data:
        t = u if u is not None else c
        want[n] = latest.get(k) is None or t is None or t >= latest[k]
        if want[n] and u is not None:
            latest[k] = u
    df = spark.createDataFrame(data, "n bigint, k bigint, c bigint, u bigint")
    start = spark.createDataFrame(list(stored.items()), "k bigint, u bigint")
    got = apply.gate(df, ["k"], "c", "u", "n", block=32, stored=start)
    assert {r.n: r.accepted for r in got.collect()} == want


def test_delete_decision_matrix(spark):
    rows = [(e, root, s, a, k) for e in ("destroyed", "updated") for root in (True, False) for s in (True, False) for a in (True, False) for k in (True, False)]
    df = spark.createDataFrame(rows, "e string, root boolean, s boolean, a boolean, k boolean")

    def want(e, root, s, a, k):
        if e == "destroyed":
            return "assign" if not root or (a and k) else "cancel" if s else "destroy"
        return ("assign" if k else "restore") if a else "none"

    got = df.select(*df.columns, apply.delete_decision(*map(F.col, df.columns)).alias("x")).collect()
    assert all(r.x == want(*r[:5]) for r in got)


def _message(event, *data, model="Rental"):
    return {"message": [{"event": event, "model_name": model, "data": list(data)}]}


def _consume(spark, messages, models, target=None, **k):
    data = [(i, ago(-i), None if m is None else m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    return apply.consume(spark.createDataFrame(data, "n bigint, received_at timestamp_ntz, message_value string"), ["n"], models, target, **k)


def test_consumer_end_to_end(spark):
    models = [ModelSpec("Rental"), ModelSpec("Client", soft_delete=False, deleted_column=None), ModelSpec("Booking")]
    at = lambda s: f"2025-01-01T00:00:{s:02}Z"
    messages = [
        _message("rental_created", {"id": 1, "name": "a", "updated_at": at(10), "links": {"bookings": [5, 6]}, "bookings": [{"id": 5, "updated_at": at(3)}, {"id": 6}]}),
        _message("rental_updated", {"id": 1, "name": "stale", "updated_at": at(9), "links": {"bookings": [7]}, "bookings": [{"id": 7}]}),
        _message("rental_updated", {"id": 1, "name": "b", "updated_at": at(10), "links": {}}),
        _message("client_created", {"id": 2, "updated_at": at(50), "links": {}}, model="Client"),
        _message("client_destroyed", {"id": 2, "updated_at": at(51), "links": {}}, model="Client"),
        _message("client_updated", {"id": 2, "updated_at": at(1), "name": "again", "links": {}}, model="Client"),
        _message("rental_destroyed", {"id": 3, "updated_at": at(20), "links": {}}),
        _message("booking_updated", {"id": 5, "updated_at": at(2), "links": {}}, model="Booking"),
        _message("rental_updated", {"id": None, "links": {}}),
        _message("rental_archived", {"id": 9, "links": {}}),
        _message("rental_updated", {"id": 9, "links": {}}, model="Unknown"),
        None,
        "null",
        "{broken",
        _message("rental_updated", {"id": 8, "links": {}}),
    ]
    state, feed, rejects = _consume(spark, messages, models, filters=[("eight", F.to_json("records").contains('"id":8'))])
    got = {(r.model, r.synced_id): r for r in state.collect()}
    assert set(got) == {("Rental", 1), ("Rental", 3), ("Client", 2), ("Booking", 5), ("Booking", 6)}
    assert json.loads(got["Rental", 1].synced_data)["name"] == "b" and json.loads(got["Client", 2].synced_data)["name"] == "again"
    assert got["Rental", 3].canceled_us == got["Rental", 3].updated_us and got["Rental", 1].canceled_us is None
    actions = {(r.model, r.synced_id, r.event): (r.accepted, r.action) for r in feed.collect()}
    assert actions["Booking", 5, "booking_updated"] == (False, "stale") and ("Booking", 7, "rental_updated") not in actions
    assert actions["Client", 2, "client_destroyed"] == (True, "destroy")
    assert sorted(r.reason for r in rejects.collect()) == ["ignored by eight", "no id", "unreadable"]
    changes = {(r.synced_id, r.attr, r.old, r.new) for r in apply.local_changes(feed).where("model = 'Rental'").collect()}
    assert (1, "name", "a", "b") in changes and (1, "name", None, "a") in changes
    assert apply.batch_event(feed).collect()[0].n_events == 8
    # a later batch goes on from the state
    state2, feed2, _ = _consume(spark, [_message("rental_updated", {"id": 3, "updated_at": at(30), "links": {}}), _message("rental_updated", {"id": 1, "updated_at": at(1), "links": {}})], models, target=state)
    after = {(r.model, r.synced_id): r for r in state2.collect()}
    assert set(after) == set(got) and after["Rental", 3].canceled_us is None
    assert sorted(r.accepted for r in feed2.collect()) == [False, True]


def _walk(state, feed, specs, model, record, place, root, kind):
    """One record and what lies in it, depth first."""
    if not isinstance(record.get("id"), int):
        return
    key, spec = (model, record["id"]), specs[model]
    old = state.get(key)
    us = lambda c: None if record.get(c) is None else int(record[c])
    time = us("updated_at") if us("updated_at") is not None else us("created_at")
    if old and old["updated_at"] is not None and time is not None and time < old["updated_at"]:
        feed[place] = False
        return
    feed[place] = True
    new = dict(old or {"created_at": None, "updated_at": None, "canceled_at": None})
    new |= {c: us(c) for c in new if c in record}
    if kind == "destroyed" and root and "canceled_at" not in record:
        new["canceled_at"] = time
    elif kind != "destroyed" and "canceled_at" not in record:
        new["canceled_at"] = None
    state[key] = new
    links = record.get("links", {})
    for many in (True, False):
        for name, link in links.items():
            inner = record.get(name)
            if isinstance(link, list) != many or inner is None:
                continue
            target = {"bookings": "Booking", "client": "Client", "rental": "Rental"}.get(name) or link["type"]
            for i, r in enumerate(inner if isinstance(inner, list) else [inner]):
                _walk(state, feed, specs, target, r, f"{place}/{0 if many else 1}/{target if name == 'owner' else name}/{i:012}", False, kind)
                if not many:
                    break


def test_consumer_matches_a_depth_first_run(spark):
    rng = random.Random(21)
    specs = {m: ModelSpec(m) for m in ("Rental", "Booking", "Client")}
    stamp = lambda: rng.randrange(1, 60)

    def record(model):
        r = {"id": rng.randrange(4), "updated_at": stamp(), "name": rng.choice("xyz")}
        if rng.random() < 0.2:
            r["canceled_at"] = rng.choice([None, stamp()])
        if rng.random() < 0.3:
            r["created_at"] = stamp()
        links = {}
        if model == "Rental":
            links = {"bookings": [1, 2], "owner": {"type": "Client", "id": 1}}
            if rng.random() < 0.7:
                r["bookings"] = [record("Booking") for _ in range(rng.randrange(3))]
            if rng.random() < 0.5:
                r["owner"] = record("Client")
        if model == "Booking":
            links = {"client": 1}
            if rng.random() < 0.5:
                r["client"] = record("Client")
            if rng.random() < 0.2:  # a cycle
                links["rental"] = 1
                r["rental"] = record("Rental")
        return r | {"links": links}

    messages, state, feed = [], {}, {}
    for n in range(120):
        model, kind = rng.choice(list(specs)), rng.choice(["created", "updated", "updated", "destroyed"])
        data = [record(model) for _ in range(rng.randrange(1, 3))]
        messages.append(_message(f"x_{kind}", *data, model=model))
        for i, r in enumerate(data):
            _walk(state, feed, specs, model, r, f"{n:012}/{0:012}/{i:012}", True, kind)
    got_state, got_feed, _ = _consume(spark, messages, list(specs.values()))
    assert {r.place: r.accepted for r in got_feed.collect()} == feed and len(feed) > 150
    got = {(r.model, r.synced_id): (r.created_us, r.updated_us, r.canceled_us) for r in got_state.collect()}
    ms = lambda v: None if v is None else v * 1000
    assert got == {k: (ms(s["created_at"]), ms(s["updated_at"]), ms(s["canceled_at"])) for k, s in state.items()}


def test_consumer_orders_by_values_not_by_texts(spark):
    record = lambda i, **k: json.dumps(_message("rental_updated", {"id": 1, "name": f"v{i}", "links": {"bookings": [1]}, "bookings": [{"id": 5, "name": f"b{i}"}]} | k))
    start = 1_700_000_000_000
    for first, second in (("a" * 20, "a" * 19 + "b"), ("x/1", "x/2"), ("long/topic/name/of/its/own", "long/topic/name/of/its/own")):
        ids = [start + i for i in range(6)] + [9_000_000_000_000_000_000 + i for i in range(6)] + [-5, 7]
        data = [(t, i, NOW, record(f"{t}-{i}")) for t in sorted({first, second}) for i in ids]
        rng = random.Random(3)
        rng.shuffle(data)
        df = spark.createDataFrame(data, "topic string, n bigint, received_at timestamp_ntz, message_value string").repartition(5)
        state, feed, _ = apply.consume(df, ["topic", "n"], [ModelSpec("Rental"), ModelSpec("Booking")])
        last = max((t, i) for t, i, *_ in data)
        assert {json.loads(r.synced_data)["name"] for r in state.collect()} == {f"v{last[0]}-{last[1]}", f"b{last[0]}-{last[1]}"}
        places = [r.place for r in feed.collect()]
        assert len(places) == len(set(places)) == 2 * len(data)
    one, two = ("a/1", "2"), ("a", "1/2")  # no two places share a name
    df = spark.createDataFrame([(*one, NOW, record(1)), (*two, NOW, record(2)), (None, "~", NOW, record(3))], "a string, b string, received_at timestamp_ntz, message_value string")
    _, feed, _ = apply.consume(df, ["a", "b"], [ModelSpec("Rental"), ModelSpec("Booking")])
    assert len({r.place for r in feed.collect()}) == 6


def test_models_may_embed_each_other(spark):
    messages = [_message("booking_created", {"id": 1, "links": {"rental": 5}, "rental": {"id": 5, "links": {"bookings": [7]}, "bookings": [{"id": 7}]}}, model="Booking")]
    state, _, rejects = _consume(spark, messages, [ModelSpec("Rental"), ModelSpec("Booking")])
    assert {(r.model, r.synced_id) for r in state.collect()} == {("Booking", 1), ("Rental", 5), ("Booking", 7)}
    assert rejects.count() == 0


def test_bulk_models_bypass_the_gate(spark):
    messages = [_message("rental_created", {"id": 1, "updated_at": "2025-01-02", "links": {}}), _message("rental_created", {"id": 1, "updated_at": "2025-01-01", "links": {}}), _message("rental_destroyed", {"id": 2, "links": {}})]
    state, feed, _ = _consume(spark, messages, [ModelSpec("Rental", bulk=True)])
    assert [r.updated_us for r in state.collect()] == [1735689600000000]
    assert sorted(r.action for r in feed.collect()) == ["bulk_destroy", "bulk_import", "bulk_import"]


def test_merge_prune_backfill(spark):
    target = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "c")], "id bigint, t bigint, v string")
    new = spark.createDataFrame([(1, 4, "x"), (2, 5, "y"), (3, 1, "z"), (4, None, "w")], "id bigint, t bigint, v string")
    assert sorted((r.id, r.v) for r in apply.upsert(target, new, ["id"], "t").collect()) == [(1, "a"), (2, "y"), (3, "z"), (4, "w")]
    assert sorted((r.id, r.v) for r in apply.upsert(target, new, ["id"]).collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert [r.id for r in apply.bulk_destroy(target, new.where("id < 3"), ["id"]).collect()] == [3]
    local = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (4, 40)], "p bigint, c bigint")
    payload = spark.createDataFrame([(1, [11]), (2, []), (3, None)], "p bigint, ids array<bigint>")
    assert sorted(map(tuple, apply.prune_children(local, payload, "p", "c").collect())) == [(1, 10), (2, 20)]
    data = spark.createDataFrame([('{"a":1}', 9), ("{}", 9), (None, 9)], "synced_data string, a bigint")
    assert [r.a for r in apply.backfill(data, {"a": "bigint"}).collect()] == [1, None, None]
    spec = ModelSpec("Rental", ("rental_type", "name"), mapping={"rental_type": "type"})
    assert apply.mapped(spec, ["type", "name", "unheard"]) == {"type": "rental_type", "name": "name"}


def test_deduplicated_batches(spark):
    record = lambda i, t=None, **k: {"id": i, "updated_at": t} | k
    at = lambda s: f"2025-01-01T00:00:{s:02}Z"
    batches = {
        1: [_message("a_updated", record(1, at(5))), _message("a_updated", record(1, at(9))), _message("a_updated", record("1", at(7))), _message("b_updated", record(1, at(1))), _message("a_updated", record(None, at(5))), _message("a_updated", record(None, at(5)))],
        2: [_message("a_updated", record(1, at(5))), _message("a_updated", record(1, at(9)), record(2, at(9)))],
        3: [_message("a_updated", record(1, at(5))), None],
        4: [_message("a_updated", record(1, at(5))), _message("a_updated", record(1)), {"message": []}, "{"],
        5: [_message("a_updated", record(1, at(5))), _message("a_updated", record(1)), _message("a_updated", record(1, at(9)))],
    }
    data = [(b, b * 10 + i, None if m is None else m if isinstance(m, str) else json.dumps(m)) for b, ms in batches.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(data, "b int, n bigint, message_value string").withColumn("first_n", F.lit("clash"))
    got = sorted((r.n, r.first_arrival) for r in apply.deduplicated(df, ["b"], ["n"]).collect())
    assert got == [(11, 10), (13, 13), (14, 14), (15, 15), *((n, n) for n in (20, 21, 30, 31, 40, 41, 42, 43)), (51, 50)]
    assert apply.deduplicated(df.limit(0), ["b"], ["n"]).count() == 0


def test_local_tables_and_links(spark):
    spec = ModelSpec("Rental", ("rental_type", "size"), mapping={"rental_type": "type"}, created_column="born", updated_column=None, deleted_column="gone")
    rows = spark.createDataFrame([(1, 10, 20, None, '{"type":"villa","size":"7","other":1}'), (2, None, None, 3, None), (3, None, None, None, '{"size":"x"}')], "synced_id bigint, created_us bigint, updated_us bigint, canceled_us bigint, synced_data string")
    got = apply.local_table(rows, spec, {"size": "int"})
    assert got.columns == ["synced_id", "rental_type", "size", "born", "gone"]
    assert sorted(map(tuple, got.collect())) == [(1, "villa", 7, 10, None), (2, None, None, None, 3), (3, None, None, None, None)]
    links = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id bigint, account bigint")
    there = spark.createDataFrame([(5, 50)], "synced_id bigint, id bigint")
    assert sorted(map(tuple, apply.resolve_to_one(links, "account", there, "synced_id", "account_id", "id").collect())) == [(1, 5, 50), (2, 6, None), (3, None, None)]


def test_root_events_hold_the_changes_of_their_children(spark):
    messages = [_message("rental_updated", {"id": 1, "name": "a", "links": {"bookings": [5]}, "bookings": [{"id": 5, "name": "b"}]}), _message("rental_updated", {"id": 1, "name": "a", "links": {"bookings": [5]}}), _message("rental_updated", {"id": None})]
    _, feed, _ = _consume(spark, messages, [ModelSpec("Rental"), ModelSpec("Booking")])
    events = {r.root_place: r for r in apply.root_events(feed, ["n"]).collect()}
    first, second = (events[f"{n:012}/{0:012}/{0:012}"] for n in (0, 1))
    assert {(c.model, c.attr, c.old, c.new) for c in first.local_changes} >= {("Rental", "name", None, "a"), ("Booking", "name", None, "b")}
    assert second.local_changes == [] and second.event == "rental_updated" and len(events) == 2


def test_replay_needs_a_model_that_the_topic_publishes(spark):
    r = registry()
    rows = spark.createDataFrame([(1, NOW), (2, ago(9))], "id bigint, updated_at timestamp_ntz")
    got = genesis.replay(rows, r, r.topics[0], "Rental", start=ago(5), end=NOW)
    assert sorted((x.id, x.event_name, x.topic) for x in got.collect()) == [(1, "rental_updated", "v3_rentals"), (1, "rental_updated", "v3_rentals_genesis")]
    assert {x.topic for x in genesis.replay(rows, r, r.topics[0], "Rental", genesis_only=True).collect()} == {"v3_rentals_genesis"}
    with pytest.raises(SpecError):
        genesis.replay(rows, r, r.topics[0], "Tax")
    snapshots = spark.createDataFrame([(1, ("x",))], "key bigint, record struct<a:string>")
    assert snapshot.record_text(rows, snapshots, r.topics[0]).collect()[0].record == '{"a":"x"}'
    assert json.loads(snapshot.record_text(rows.select("id"), snapshots, Topic("v3", "raw", serialize=False)).orderBy("key").collect()[0].record) == {"id": 1}
    assert snapshot.tombstones(snapshots.select("key")).collect()[0].value is None


def test_changesets_of_all_models_are_encrypted(spark, tmp_path):
    rows = [(n, model, "1", None, None, name, "updated") for n, (model, name) in enumerate([("Tax", "a"), ("Rental", "a"), ("Client", "a"), ("Rental", "b"), ("Client", "a")])]
    schema = "arrival_no bigint, model_name string, synced_id string, synced_canceled_at string, synced_account_id bigint, name string, event string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/deserialized_records.parquet")
    got = sorted(tuple(r) for r in cdc.QUERIES["changeset_encrypted_all"](spark, str(tmp_path)).collect())
    assert got == [(0, "Tax", 1), (1, "Rental", 1), (2, "Client", 1), (3, "Rental", 1), (4, "Client", 0)]


def test_rescan_covers_all_jobs(spark, tmp_path):
    spark.range(2500).selectExpr("id * 3 AS o_orderkey", "id * 1.5D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in cdc.QUERIES["genesis_rescan_all"](spark, str(tmp_path)).collect())
    assert got == [(n // 1000, 3 * n, 1.5 * n) for n in range(2500)]
    jobs = spark.createDataFrame([(0, [1, 1, 2]), (1, [2])], "batch_no int, ids array<bigint>")
    assert sorted(tuple(r) for r in genesis.rescan_by_job(spark.range(30), jobs, "id").select("batch_no", "id").collect()) == [(0, 1), (0, 2), (1, 2)]
