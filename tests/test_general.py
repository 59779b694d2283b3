"""Operators of problems 1 to 5 on small cases and against brute force."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.operators import incremental, nested, once, orphans, replay
from weirflow.operators.scan import running

T0 = dt.datetime(2025, 1, 1)
FEED = "arrival_no bigint, received_at timestamp_ntz, model_name string, event string, synced_id string, synced_account_id bigint, synced_created_at string, synced_updated_at string, synced_canceled_at string, name string"


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def iso(s: float) -> str:
    return at(s).isoformat() + "Z"


def us(s: float) -> int:
    return int((at(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_wire_numbers(spark):
    cases = {"7": 7, " 007\t": 7, "7.0": 7, "7.5": None, "": None, "  ": None, None: None, "x": None, "1e2": 100, "99999999999999999999": None, "7.0000001": None, "+7.": 7, ".0": 0, "7." + "0" * 30 + "1": None, "7" * 18 + ".000": int("7" * 18), "70e-1": 7, "75e-1": None, ".": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", wire.whole_number(F.col("v")))
    assert dict(df.collect()) == cases


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_wire_times(spark, zone):
    same = "2025-03-01T12:00:00.5Z", "2025-03-01 12:00:00.500", "2025-03-01T14:00:00.500+02:00", "2025-03-01T07:00:00.500-05:00", " 2025-03-01 12:00:00.5 UTC ", "1740830400500", "2025-03-01T12:00:00.500000"
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in (*same, "", None, "soon", "2025-03-01", "12:00", "9223372036854775807", "9" * 40)], "v string").select(wire.epoch_us(F.col("v")))
        got = [r[0] for r in df.collect()]
        stamp = spark.createDataFrame([(1,)], "i int").select(wire.us_of(F.lit(dt.datetime(2025, 3, 1, 12)).cast("timestamp_ntz")))
        assert stamp.collect()[0][0] == 1740830400000000 or zone != "UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1740830400500000] * len(same) + [None, None, None, 1740787200000000, None, None, None]


@pytest.mark.parametrize("backwards,inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_running_matches_a_plain_scan(spark, backwards, inclusive):
    rng = random.Random(3)
    data = [(rng.choice("aab"), n, rng.choice([None, rng.randrange(100)])) for n in range(300)]
    df = spark.createDataFrame(data, "k string, n bigint, v bigint").withColumn("b", F.floor(F.col("n") / 16))
    got = {(r.k, r.n): r.o for r in running(df, ["k"], "b", ["n"], "v", "o", backwards=backwards, inclusive=inclusive).collect()}
    for k, n, _ in data:
        seen = [v for kk, nn, v in data if kk == k and v is not None and ((nn > n if backwards else nn < n) or (inclusive and nn == n))]
        assert got[(k, n)] == (max(seen) if seen else None)


# --- problem 1


def _links(spark, texts):
    data = [(i, t, at(1000)) for i, t in enumerate(texts)]
    return orphans.references(spark.createDataFrame(data, "record_no bigint, links string, received_at timestamp_ntz"))


def test_references(spark):
    texts = [
        '{"account":"0042","rental":null,"client":"","bookings_fees":["7",7,8.0,null,""],"bookable":{"type":" rental","id":5},"users":[1],"fee":{}}',
        '{"account":1',
        '{"account":1} {"account":2}',
        '{"account":1}]',
        '[{"account":1}]',
        '{"account":1},{"account":2}',
        "",
        None,
        '{"bookable":{"type":"Property","id":"9"},"taxes":[],"booking":"x"}',
        '{"bookable":{"id":9},"client":{"type":"Client"}}',
    ]
    got = rows(_links(spark, texts).select("record_no", "relation", "model", "target_id"))
    assert got == sorted(
        [(0, "account", "Account", 42), (0, "bookings_fees", "BookingsFee", 7), (0, "bookings_fees", "BookingsFee", 8), (0, "bookable", "Rental", 5), (8, "bookable", "Property", 9)], key=repr
    )


def test_orphans_stand_by_moment(spark):
    feed = [
        # the record's own time decides, not the order of arrival
        (1, at(10), "rental", "rental_created", "1", 1, iso(1), iso(5), None, "a"),
        (2, at(20), "Rental ", "rental_destroyed", "1", 1, iso(1), iso(3), None, "a"),
        (3, at(30), "RENTAL", "rental_destroyed", "1", 1, iso(1), iso(6), None, "a"),
        (4, at(40), "Rental", "rental_recreated", "1", 1, iso(1), iso(9), "", "a"),
        (5, at(50), "Rental", "rental_updated", "1", 1, iso(1), iso(10), iso(10), "a"),
        (6, at(1), "Rental", "rental_touched", "2", 1, iso(1), iso(10), None, "a"),
        (7, at(1), "Rental", "rental_updated", "3", 1, None, None, None, "a"),
    ]
    accounts = [(1, at(100), at(200)), (2, at(100), None), (3, at(100), at(100))]
    parents = orphans.feed_changes(spark.createDataFrame(feed, FEED)).unionByName(
        orphans.account_changes(spark.createDataFrame(accounts, "synced_id bigint, synced_created_at timestamp_ntz, synced_canceled_at timestamp_ntz"))
    )
    asked = [("Rental", 1, t) for t in (9, 10, 20, 29, 30, 40, 50)] + [("Rental", 2, 60), ("Rental", 3, 60)]
    asked += [("Account", 1, t) for t in (99, 100, 199, 200)] + [("Account", 2, 10**6), ("Account", 3, 100), ("Account", 9, 100)]
    children = spark.createDataFrame([(i, us(t), "r", m, k) for i, (m, k, t) in enumerate(asked)], "record_no bigint, received_us bigint, relation string, model string, target_id bigint")
    for width in (7_000_000, orphans.WEEK_US):
        bad = {r.record_no for r in orphans.orphans(children, parents, width).collect()}
        assert [asked[i] for i in sorted(bad)] == [("Rental", 1, 9), ("Rental", 1, 30), ("Rental", 1, 50), ("Rental", 2, 60), ("Rental", 3, 60), ("Account", 1, 99), ("Account", 1, 200), ("Account", 3, 100), ("Account", 9, 100)]
    assert orphans.orphans(children.limit(0), parents).count() == 0
    assert orphans.orphans(children, parents.limit(0)).count() == len(asked)
    assert sum(r.orphans for r in orphans.by_period(orphans.orphans(children, parents)).collect()) == 9


# --- problem 2


def _naive(changes):
    state = {}
    for c in sorted(changes, key=lambda c: c["seq"]):
        s = state.setdefault(c["k"], {"seq": None, "gone": False, "a": None, "b": None})
        if s["seq"] == c["seq"]:
            continue
        s["seq"], s["gone"] = c["seq"], c["gone"]
        if c["gone"]:
            s["a"] = s["b"] = None
        for x in "ab":
            if c[x] is not None and not c["gone"]:
                s[x] = c[x]
    return {k: (s["seq"], s["a"], s["b"]) for k, s in state.items() if not s["gone"]}


def test_replay_matches_a_sequential_fold(spark):
    rng = random.Random(5)
    schema = "k bigint, seq bigint, gone boolean, a string, b bigint"
    changes = []
    for k in range(40):
        for n in rng.sample(range(1000), rng.randrange(1, 40)):
            gone = rng.random() < 0.15
            changes.append({"k": k if k < 30 else 0, "seq": n * 40 + k, "gone": gone, "a": None if gone or rng.random() < 0.4 else f"v{n}", "b": None if gone or rng.random() < 0.4 else n})
    again = changes + rng.choices(changes, k=200)
    rng.shuffle(again)
    df = spark.createDataFrame(again, schema).repartition(7)
    states = replay.replay(df, ["k"], ["a", "b"])
    got = {r.k: (r.seq, r.a, r.b) for r in replay.present(states, ["k"], ["a", "b"]).collect()}
    assert got == _naive(changes)
    half = len(again) // 2
    first = replay.replay(spark.createDataFrame(again[:half], schema), ["k"], ["a", "b"])
    second = replay.replay(spark.createDataFrame(again[half:], schema), ["k"], ["a", "b"], state=first)
    assert rows(replay.present(second, ["k"], ["a", "b"])) == rows(replay.present(states, ["k"], ["a", "b"]))
    assert replay.replay(df.limit(0), ["k"], ["a", "b"]).count() == 0


def test_feed_changes_read_what_counts(spark):
    feed = [
        (1, at(1), " booking", "booking_created", "5.0", 1, iso(1), None, None, "n"),
        (2, at(1), "Booking", "booking_updated", "", 1, iso(1), None, None, "n"),
        (3, at(1), "Booking", "booking_archived", "5", 1, iso(9), None, None, "n"),
        (4, at(1), "Unheard", "x_updated", "5", 1, iso(9), None, None, "n"),
        (5, at(1), "Booking", "booking_updated", "5", 1, "", "", None, "n"),
        (6, None, None, None, None, None, None, None, None, None),
    ]
    got = rows(replay.feed_changes(spark.createDataFrame(feed, FEED).withColumn("seq", F.lit("clash"))).select("model_name", "synced_id", "seq"))
    assert got == [("Booking", 5, 2 * us(1))]


# --- problem 3


def _paths(spark, values):
    nodes = nested.label(spark.createDataFrame(list(enumerate(values)), "message_id bigint, message_value string"))
    return nodes, rows(nested.link(nodes).select("message_id", "parent_path", "record_path"))


def test_nested_paths(spark):
    deep = {"id": 1, "links": {"fee": 2, "taxes": [3, 4], "note": None}, "fee": {"id": 2, "links": {"x": 5}, "x": [None, {"id": 5}, 7]}, "taxes": [{"id": 3}, {"id": 4, "links": {"fee": 9}, "fee": {"id": 9}}], "other": {"links": {"fee": 1}, "fee": {"id": 1}}}
    envelope = {"message": [{"event": "a", "model_name": "Rental", "data": [deep, None, {"id": 8, "links": {"fee": 1}, "fee": {"id": 1}}]}, {"data": deep}]}
    text = json.dumps(envelope)
    values = [text, json.dumps(text), None, "", "null", "{}", '{"payload":[]}', "[1", '{"message":null}', json.dumps({"message": {"data": {"id": 1, "links": {"a": 1}, "a": {"id": 2}}}}), '{"message":[{"data":{"links":{"links":1},"links":{"id":1}}}]}', "[" * 200_000, '{"message":NaN}']
    nodes, got = _paths(spark, values)
    tree = [("0/0", "0/0/fee:0"), ("0/0/fee:0", "0/0/fee:0/x:1"), ("0/0", "0/0/taxes:0"), ("0/0", "0/0/taxes:1"), ("0/0/taxes:1", "0/0/taxes:1/fee:0"), ("0/2", "0/2/fee:0"), ("1/0", "1/0/fee:0"), ("1/0/fee:0", "1/0/fee:0/x:1"), ("1/0", "1/0/taxes:0"), ("1/0", "1/0/taxes:1"), ("1/0/taxes:1", "1/0/taxes:1/fee:0")]
    assert got == sorted([(m, *p) for m in (0, 1) for p in tree] + [(9, "0/0", "0/0/a:0")], key=repr)
    every = nodes.collect()
    assert all(r.pre < r.post for r in every)
    assert {r.model_name for r in every if r.record_path.endswith("taxes:0")} == {"Tax"}
    assert nested.link(nodes.limit(0)).count() == 0


def test_nested_deep_chain(spark):
    record = {"id": 0}
    for i in range(1, 300):
        record = {"id": i, "links": {"a": 1}, "a": record}
    _, got = _paths(spark, [json.dumps({"message": [{"data": record}]})])
    assert len(got) == 299 and all(child == parent + "/a:0" for _, parent, child in got)


def test_nested_below_deep_attributes(spark):
    deep = "[" * 12_000 + "]" * 12_000
    text = '{"message":[{"model_name":"Rental","data":[{"id":1,"settings":' + deep + ',"links":{"fee":2},"fee":{"id":2}},{"id":3}]}]}'
    nodes, got = _paths(spark, [text])
    assert got == [(0, "0/0", "0/0/fee:0")]
    assert sorted(r.record_id for r in nodes.collect()) == ["1", "2", "3"]
    assert [r.attributes for r in nodes.where("record_id = '1'").collect()] == ['{"settings": ' + deep + "}"]


def test_node_tables(spark):
    tax = {"id": "9", "name": "t", "updated_at": "2025-01-01", "links": {"account": "07"}}
    rental = {"id": 1, "name": 5, "canceled_at": None, "links": {"taxes": [9, 10], "fee": {"type": "Tax", "id": 3}, "account": 4}, "taxes": [tax, {"id": "x"}], "fee": {"id": 3}}
    values = [json.dumps({"message": [{"model_name": "Rental", "data": [rental]}, {"model_name": "Tax", "data": tax}]}), None, "{"]
    nodes = nested.label(spark.createDataFrame(list(enumerate(values)), "message_id bigint, message_value string").withColumn("depth", F.lit("clash")))
    taxes = nested.node_table(nodes, "Tax", {"name": "string", "nothing": "bigint"}, ("account",))
    assert dict(taxes.dtypes)["id"] == "bigint" and dict(taxes.dtypes)["updated_us"] == "bigint"
    got = {r.record_path: (r.parent_path, r.parent_model, r.parent_id, r.id, r.name, r.nothing, r.updated_us, r.account_id) for r in taxes.collect()}
    day = 1735689600000000
    assert got == {
        "0/0/taxes:0": ("0/0", "Rental", 1, 9, "t", None, day, 7), "0/0/taxes:1": ("0/0", "Rental", 1, None, None, None, None, None),
        "0/0/fee:0": ("0/0", "Rental", 1, 3, None, None, None, None), "1/0": (None, None, None, 9, "t", None, day, 7),
    }
    assert [r.name for r in nested.node_table(nodes, "Rental").collect()] == ["5"]
    assert nested.node_table(nodes.limit(0), "Tax").count() == 0


# --- problem 4


def _numbers(df):
    return {n for r in df.collect() for n in range(r.lo, r.hi + 1)}


def test_interval_algebra(spark):
    rng = random.Random(11)
    for _ in range(3):
        make = lambda n: [("a", s, s + rng.randrange(-1, 9)) for s in (rng.randrange(120) for _ in range(n))]
        a, b = make(12), make(9)
        left, right = (spark.createDataFrame(x, "k string, lo bigint, hi bigint") for x in (a, b))
        merged = incremental.merge(left, ["k"])
        found = sorted((r.lo, r.hi) for r in merged.collect())
        assert _numbers(merged) == _numbers(left) and all(x[1] + 1 < y[0] for x, y in zip(found, found[1:]))
        assert _numbers(incremental.subtract(left, right, ["k"])) == _numbers(left) - _numbers(right)
    assert _numbers(incremental.subtract(left, right.limit(0), ["k"])) == _numbers(left)


OUTBOX = "id bigint, topic string, published_at timestamp_ntz, retry_at timestamp_ntz, updated_at timestamp_ntz, loaded_at timestamp_ntz"


def test_due_matches_a_sequential_run(spark):
    rng = random.Random(2)
    data, runs = [], []
    for i in range(120):
        topic, loads = rng.choice(["a", "a", "b", None]), []
        for v in range(rng.randrange(1, 5)):
            made = rng.randrange(0, 400_000)
            loads.append((i, topic, at(made) if rng.random() < 0.3 else None, at(made + rng.randrange(90_000)) if rng.random() < 0.4 else None, at(made), at(made + rng.randrange(200_000))))
        data += loads + [(*x[:5], x[5] + dt.timedelta(hours=3)) for x in loads if rng.random() < 0.2]
    for n in range(90):
        runs.append((n, rng.choice("ab"), at(rng.randrange(600_000)), rng.choice(["succeeded", "succeeded", "failed", "abandoned"])))
    taken, want = set(), set()
    for n, topic, began, outcome in sorted(runs, key=lambda r: (r[2], r[0])):
        current = {}
        for r in data:
            if r[1] == topic and r[5] <= began and (r[0] not in current or current[r[0]][4] < r[4]):
                current[r[0]] = r
        for r in current.values():
            if outcome == "succeeded" and r[2] is None and (r[3] is None or r[3] <= began) and (r[0], r[4]) not in taken:
                taken.add((r[0], r[4]))
                want.add((n, r[0]))
    rng.shuffle(data)
    box = spark.createDataFrame(data, OUTBOX).withColumn("block", F.lit("clash")).withColumn("hi", F.lit(None).cast("string"))
    ran = spark.createDataFrame(runs, "run_no bigint, topic string, began_at timestamp_ntz, outcome string")
    assert {(r.run_no, r.outbox_id) for r in incremental.due(box, ran).collect()} == want and want
    assert incremental.due(box.limit(0), ran).count() == 0 and incremental.due(box, ran.limit(0)).count() == 0


def _relanded(spark):
    """Two versions land before the first epoch's end; one of them lands again, and a late one of an earlier moment lands for the first time, after it."""
    box = [(1, "a", None, None, at(10), at(20)), (2, "a", None, None, at(30), at(40)), (1, "a", None, None, at(10), at(500)), (3, "a", None, None, at(20), at(510))]
    runs = [(n, "a", at(t), "succeeded") for n, t in enumerate((50, 60, 70, 400, 505, 600))]
    return spark.createDataFrame(box, OUTBOX), spark.createDataFrame(runs, "run_no bigint, topic string, began_at timestamp_ntz, outcome string")


def test_due_subtracts_what_the_ledger_holds(spark, tmp_path, monkeypatch):
    box, runs = _relanded(spark)
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    want = {(0, 1), (0, 2), (5, 3)}
    assert {(r.run_no, r.outbox_id) for r in incremental.due(box, runs, 2, ledger).collect()} == want
    assert [(r.lo, r.hi) for r in ledger.processed(incremental.INTERVALS).collect()] == [(0, 2)]  # the late version filled the gap
    assert rows(incremental.due(box, runs, 2, ledger)) == rows(incremental.due(box, runs, 1))  # again, with the same ledger: nothing is added
    assert {(r.run_no, r.outbox_id) for r in incremental.due(box, runs, 3).collect()} == want
    monkeypatch.setattr(incremental, "subtract", lambda available, processed, keys: incremental.merge(available, keys))
    assert {(r.run_no, r.outbox_id) for r in incremental.due(box, runs, 2).collect()} == want | {(4, 1)}


def test_due_starts_again_after_a_failure(spark, tmp_path, monkeypatch):
    box, runs = _relanded(spark)
    ledger, commit, calls = incremental.Ledger(spark, str(tmp_path / "ledger")), incremental.Ledger.commit, []

    def breaks(self, *args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        return commit(self, *args)

    monkeypatch.setattr(incremental.Ledger, "commit", breaks)
    with pytest.raises(OSError):
        incremental.due(box, runs, 2, ledger)
    assert {(r.run_no, r.outbox_id) for r in incremental.due(box, runs, 2, ledger).collect()} == {(0, 1), (0, 2), (5, 3)}


def test_positions_are_dense_whatever_the_values(spark):
    from weirflow.operators.scan import positions

    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(10**15)) for _ in range(400)] + [(None, 5)]
    got = positions(spark.createDataFrame(data, "k string, v bigint"), ["k", "v"], "n", 7).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert sorted(r.n for r in got) == list(range(401))
    assert positions(spark.createDataFrame([], "v bigint"), ["v"], "n").count() == 0


def test_ledger_commits_whole_or_not_at_all(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path))
    schema = "k string, lo bigint, hi bigint"
    gap = lambda lo, hi: spark.createDataFrame([("a", lo, hi)], schema)
    assert ledger.output() is None and ledger.processed(schema).count() == 0
    ledger.commit(spark.range(0, 10), gap(0, 9), ["k"])
    # a run that dies after writing its output, before the manifest
    spark.range(10, 20).write.parquet(str(tmp_path / "parts" / "2-dead"))
    assert ledger.output().count() == 10
    left = incremental.subtract(gap(0, 29), ledger.processed(schema), ["k"])
    assert [(r.lo, r.hi) for r in left.collect()] == [(10, 29)]
    ledger.commit(spark.range(10, 30), left, ["k"])
    assert sorted(r.id for r in ledger.output().collect()) == list(range(30))
    assert [(r.lo, r.hi) for r in ledger.processed(schema).collect()] == [(0, 29)]


# --- problem 5


def test_accept_once_over_batches(spark):
    rng = random.Random(8)
    data = []
    for n in range(600):
        kind = rng.random()
        producer = rng.choice(["p", "p", "q"]) if kind < 0.9 else None
        number = rng.randrange(60) + (once.BLOCK - 30 if rng.random() < 0.5 else 0)
        data.append((n, producer, number if producer else None, rng.choice(["x", "y", None]) if not producer else None))
    schema = "arrival bigint, producer string, number bigint, exact string"
    args = (F.col("producer"), F.col("number"), F.col("exact"), "arrival")
    want, seen = set(), set()
    for n, p, k, e in data:
        key = (p, k) if p else ("exact", e)
        if key == ("exact", None) or key not in seen:
            want.add(n)
        seen.add(key)
    df = spark.createDataFrame(data, schema).withColumn("block", F.lit("clash"))
    kept, ranges = once.accept(df, *args)
    assert {r.arrival for r in kept.collect()} == want
    assert {r.arrival for r in once.duplicates(df, kept, "arrival").collect()} == {d[0] for d in data} - want
    found = sorted((r.producer, r.lo, r.hi) for r in ranges.collect())
    assert {(p, n) for p, lo, hi in found for n in range(lo, hi + 1)} == {(p, k) for _, p, k, _ in data if p}
    numbered = [d for d in data if d[1]]
    a, b = (spark.createDataFrame(x, schema) for x in (numbered[:200], numbered[200:]))
    one, held = once.accept(a, *args)
    two, both = once.accept(b, *args, seen=held)
    assert {r.arrival for r in one.unionByName(two).collect()} == {n for n in want if data[n][1]}
    assert sorted((r.producer, r.lo, r.hi) for r in both.collect()) == found
    assert once.accept(df.limit(0), *args)[0].count() == 0
    texts = once.texts(spark.createDataFrame([d for d in data[:300]], schema), *args[:3])
    late, _ = once.accept(spark.createDataFrame([d for d in data[300:] if not d[1]], schema), *args, seen_texts=texts)
    told = {e for _, p, _, e in data[:300] if not p}
    assert {r.arrival for r in late.collect()} == {n for n, p, _, e in data[300:] if not p and (e is None or (e not in told and n in want))}


def test_parts_hand_on_ranges_and_texts(spark, monkeypatch):
    rng = random.Random(18)
    data = []
    for n in range(500):
        producer = rng.choice(["p", "p", "q", None])
        number = rng.randrange(200) + (once.BLOCK - 100 if rng.random() < 0.5 else 0)
        data.append((n, None if n < 3 else n // 9 * 10, producer, number if producer else None, rng.choice(["x", "y", None]) if not producer else None))
    df = spark.createDataFrame(data, "arrival bigint, batch bigint, producer string, number bigint, exact string")
    args = (F.col("producer"), F.col("number"), F.col("exact"), "arrival")
    kept, ranges = once.accept(df, *args)
    for parts in (1, 4):
        found, held = once.accept_in_parts(df, *args, "batch", parts)
        assert rows(found) == rows(kept) and rows(held) == rows(ranges)
    assert max(r.hi - r.lo for r in held.collect()) > 3  # numbers that follow each other are one range
    assert once.accept_in_parts(df.limit(0), *args, "batch")[0].count() == 0
    nothing = df.select("producer", F.lit(0).cast("bigint").alias("block"), F.col("number").alias("lo"), F.col("number").alias("hi")).limit(0)
    monkeypatch.setattr(once, "merged", lambda swept: nothing)
    assert once.accept_in_parts(df, *args, "batch", 2)[0].count() > len(rows(kept))  # the ranges are what tells copies in later parts
