"""Queries of the change-data-capture operators, each with the same in SQL."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import naming, wire
from weirflow.operators import apply, classify, decode, fanout, genesis, incremental, outbox, snapshot
from weirflow.plans import pipeline
from weirflow.plans.spec import ModelSpec, Observation, Publication, Registry, Relation, Topic
from weirflow.sources.tables import OUTBOX, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


NOW = dt.datetime(2025, 4, 8, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2025-04-08 12:00:00'"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


REGISTRY = Registry(
    {
        "Account": ModelSpec("Account", ("name",)),
        "Rental": ModelSpec("Rental", ("name",), (Relation("account", "Account", "account_id"), Relation("taxes", "Tax", "rental_id", many=True))),
        "Booking": ModelSpec("Booking", ("name",), (Relation("client", "Client", "client_id"), Relation("bookings_fees", "BookingsFee", "booking_id", many=True))),
        "BookingsFee": ModelSpec("BookingsFee", ("name",)),
        "Client": ModelSpec("Client", ("name",)),
        "Fee": ModelSpec("Fee", ("name",)),
        "Tax": ModelSpec("Tax", ("name",)),
    },
    (
        Topic("v3", "rentals", (Publication("Rental", ("account", "taxes"), (Observation("Client", ("name",), "bookings.rental"),)),), genesis_replica=True),
        Topic("v3", "bookings", (Publication("Booking", ("client", "bookings_fees")),)),
        Topic("v3", "clients", (Publication("Client"),)),
    ),
)

CUSTOMER = ModelSpec("Customer", ("c_name", "c_mktsegment"), primary_key="c_custkey")
LINE = ModelSpec("Line", ("l_linenumber", "l_quantity", "l_extendedprice"), primary_key="l_partkey")
ORDER = ModelSpec(
    "Order",
    ("o_orderstatus", "o_totalprice"),
    (Relation("customer", "Customer", "o_custkey"), Relation("lines", "Line", "l_orderkey", many=True)),
    primary_key="o_orderkey",
)

# --- consumer: last writer wins, duplicates ------------------------------------------------------


def _gated(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("updated", wire.us_of(F.col("o_orderdate"))).withColumn("created", F.lit(None).cast("bigint"))
    return apply.gate(rows, ["o_custkey"], "created", "updated", "o_orderkey")


@query(
    """SELECT o_orderkey, o_custkey, coalesce(o_orderdate >= max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
    FROM orders"""
)
def lww_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-08, W-03, R-04: rows accepted by the gate, in order of arrival."""
    return _gated(spark, sf_dir).select("o_orderkey", "o_custkey", "accepted")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def lww_snapshot(spark, sf_dir):
    """F-08, K-05, R-05: the row that stands for every key."""
    return apply.latest_state(_gated(spark, sf_dir), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """SELECT event_type, user_id, event_id, min(event_id) OVER (PARTITION BY event_type, user_id) AS first_arrival FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) = 1"""
)
def dedupe_latest(spark, sf_dir):
    """A-01: the latest row of every (event, id), with its group's place."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    return apply.dedupe_latest(rows, ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "first_arrival")


@query(
    """WITH keyed AS (SELECT arrival_no, event, lower(trim(model_name)) AS model, trim(synced_id) AS id, synced_updated_at AS t FROM deserialized_records WHERE synced_id IS NOT NULL)
    SELECT event, model, id, arrival_no, min(arrival_no) OVER (PARTITION BY event, model, id) AS first_arrival FROM keyed
    QUALIFY row_number() OVER (PARTITION BY event, model, id ORDER BY t DESC NULLS FIRST, CASE WHEN t IS NULL THEN -arrival_no ELSE arrival_no END) = 1"""
)
def dedupe_feed(spark, sf_dir):
    """A-01 with missing times: they count as just now."""
    feed = table(spark, sf_dir, "deserialized_records").where("synced_id is not null")
    rows = feed.select("arrival_no", "event", wire.model_key(F.col("model_name")).alias("model"), F.btrim("synced_id").alias("id"), F.col("synced_updated_at").alias("t"))
    return apply.dedupe_latest(rows, ["event", "model", "id"], "t", "arrival_no").drop("t")


_MESSAGE = """m AS (SELECT *, CASE WHEN json_valid(v) AND json_type(v) = 'OBJECT' THEN json_extract(v, '$.message') END AS msg FROM (
    SELECT *, CASE WHEN json_valid(message_value) THEN CASE WHEN json_type(message_value) = 'VARCHAR' THEN message_value ->> '$' ELSE message_value END END AS v FROM messages) q)"""
_EVENTS = _MESSAGE + """, ev AS (SELECT * EXCLUDE (l), unnest(range(len(l))) AS event_no, unnest(l) AS e FROM (
    SELECT *, CASE json_type(msg) WHEN 'ARRAY' THEN json_extract(msg, '$[*]') WHEN 'OBJECT' THEN [msg] END AS l FROM m) q WHERE l IS NOT NULL)"""
_RECORDS = _EVENTS + """, rec AS (SELECT * EXCLUDE (l), unnest(range(len(l))) AS record_no, unnest(l) AS r FROM (
    SELECT *, CASE json_type(d) WHEN 'ARRAY' THEN json_extract(d, '$[*]') WHEN 'OBJECT' THEN [d] END AS l FROM (SELECT *, json_extract(e, '$.data') AS d FROM ev) q) q2 WHERE l IS NOT NULL)"""


@query(
    f"""WITH {_MESSAGE} SELECT topic, partition_no, count(*) AS n_messages, bool_and(coalesce(
      CASE WHEN json_type(msg) = 'ARRAY' AND json_array_length(msg) = 1 THEN
        CASE json_type(json_extract(msg, '$[0].data')) WHEN 'ARRAY' THEN json_array_length(json_extract(msg, '$[0].data')) = 1 WHEN 'OBJECT' THEN true END
      END, false)) AS applies FROM m GROUP BY topic, partition_no"""
)
def dedupe_applicability(spark, sf_dir):
    """R-03: whether duplicates may be removed from a batch (here: a topic's partition)."""
    return apply.dedupe_applies(table(spark, sf_dir, "messages"), ["topic", "partition_no"])


# --- outbox --------------------------------------------------------------------------------------


@query(
    """SELECT id, updated_at, loaded_at FROM (SELECT *, lead((resource_class, resource_id, event_name)) OVER (PARTITION BY topic ORDER BY created_at, id, updated_at, loaded_at) AS nxt,
      (resource_class, resource_id, event_name) AS k FROM dionysus_outbox_without_changesets) q WHERE nxt IS NULL OR nxt <> k"""
)
def consecutive_dedupe(spark, sf_dir):
    """W-01: the last row of every run of equal neighbours in a topic."""
    rows = table(spark, sf_dir, OUTBOX).select("id", "updated_at", "loaded_at", "created_at", *outbox.RUN_KEY)
    return outbox.consecutive_dedupe(rows, ["created_at", "id", "updated_at", "loaded_at"]).select("id", "updated_at", "loaded_at")


@query("SELECT DISTINCT topic FROM dionysus_outbox_without_changesets WHERE published_at IS NULL")
def pending_topics(spark, sf_dir):
    """S-10, A-05, F-01."""
    return outbox.pending_topics(table(spark, sf_dir, OUTBOX))


@query(f"SELECT topic, id, updated_at FROM dionysus_outbox_without_changesets WHERE published_at >= {NOW_SQL}")
def published_since(spark, sf_dir):
    """S-11."""
    return outbox.published_since(table(spark, sf_dir, OUTBOX), _now()).select("topic", "id", "updated_at")


_DUE = f"published_at IS NULL AND (retry_at IS NULL OR retry_at <= {NOW_SQL})"


@query(
    f"""SELECT topic, rank::INT AS rank, id FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY created_at, id, updated_at, loaded_at) AS rank
    FROM dionysus_outbox_without_changesets WHERE {_DUE}) q WHERE rank <= 100"""
)
def fetch_publishable(spark, sf_dir):
    """S-09, T-01, F-01, F-02: the oldest due rows of every topic, a poll's batch each."""
    rows = outbox.publishable(table(spark, sf_dir, OUTBOX), _now())
    return outbox.first_per_topic(rows, order=("created_at", "id", "updated_at", "loaded_at")).select("topic", "rank", "id")


@query(f"SELECT topic, count(*) AS n_due FROM dionysus_outbox_without_changesets WHERE {_DUE} AND created_at <= {NOW_SQL} - INTERVAL 3600 SECOND GROUP BY topic")
def publishing_delay(spark, sf_dir):
    """F-03: due rows that have waited for the delay."""
    return outbox.publishable(table(spark, sf_dir, OUTBOX), _now(), delay_s=3600).groupBy("topic").agg(F.count("*").alias("n_due"))


@query("SELECT id, updated_at, loaded_at, 5.0 * pow(2, attempts) AS wait_s FROM dionysus_outbox_without_changesets WHERE attempts > 0")
def retry_backoff(spark, sf_dir):
    """R-14, A-10: seconds until the next attempt."""
    return table(spark, sf_dir, OUTBOX).where("attempts > 0").select("id", "updated_at", "loaded_at", outbox.backoff_s(F.col("attempts")).alias("wait_s"))


_BATCH = f"""batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, loaded_at DESC) AS n FROM dionysus_outbox_without_changesets WHERE {_DUE}) q WHERE n = 1)"""


@query(
    f"""WITH {_BATCH} SELECT id, CASE WHEN error_class IS NULL THEN {NOW_SQL} END AS published_at, attempts + CASE WHEN error_class IS NULL THEN 0 ELSE 1 END AS attempts,
      CASE WHEN error_class IS NOT NULL THEN {NOW_SQL} + to_seconds(5 * pow(2, attempts + 1)) END AS retry_at, error_class FROM batch"""
)
def settle_batch(spark, sf_dir):
    """K-03, K-04, U-01, A-10: a batch after publishing; rows that carry an error fail again, all others are published."""
    due = outbox.publishable(table(spark, sf_dir, OUTBOX), _now())
    batch = due.groupBy("id").agg(F.max_by(F.struct(*(c for c in due.columns if c != "id")), F.struct("updated_at", "loaded_at")).alias("r")).select("id", "r.*")
    failed = batch.where("error_class is not null").select("id", "error_class", "error_message")
    return outbox.settle(batch, failed, _now()).select("id", "published_at", "attempts", "retry_at", "error_class")


@query(
    """SELECT topic, date_trunc('minute', published_at) AS minute, min(s) AS min_s, max(s) AS max_s, round(avg(s), 3) AS avg_s, count(*) AS published
    FROM (SELECT *, (epoch_us(published_at) - epoch_us(created_at)) / 1e6 AS s FROM dionysus_outbox_without_changesets WHERE published_at IS NOT NULL) q GROUP BY 1, 2"""
)
def outbox_latency(spark, sf_dir):
    """A-02, R-16, K-13: latencies per minute."""
    return outbox.latency_by_minute(table(spark, sf_dir, OUTBOX)).withColumn("avg_s", F.round("avg_s", 3))


@query(
    f"""SELECT coalesce(min(s), 0) AS min_s, coalesce(max(s), 0) AS max_s, round(coalesce(avg(s), 0), 3) AS avg_s, coalesce(max(w), 0) AS oldest_s FROM (
      SELECT CASE WHEN published_at BETWEEN {NOW_SQL} - INTERVAL 60 SECOND AND {NOW_SQL} THEN (epoch_us(published_at) - epoch_us(created_at)) / 1e6 END AS s,
        CASE WHEN published_at IS NULL THEN (epoch_us({NOW_SQL}) - epoch_us(created_at)) / 1e6 END AS w FROM dionysus_outbox_without_changesets) q"""
)
def outbox_oldest_pending(spark, sf_dir):
    """A-02, A-03: the four gauges at one moment."""
    return outbox.latency(table(spark, sf_dir, OUTBOX), _now()).withColumn("avg_s", F.round("avg_s", 3))


@query("SELECT id, updated_at, loaded_at, nullif(concat_ws(': ', nullif(error_class, ''), nullif(error_message, '')), '') AS error FROM dionysus_outbox_without_changesets WHERE failed_at IS NOT NULL")
def outbox_errors(spark, sf_dir):
    """Errors put together again from their class and message."""
    failed = table(spark, sf_dir, OUTBOX).where("failed_at is not null")
    return failed.select("id", "updated_at", "loaded_at", outbox.error_text(F.col("error_class"), F.col("error_message")).alias("error"))


@query(
    """SELECT o.id, o.updated_at, o.loaded_at, coalesce(a.synced_created_at, o.created_at) AS age_at FROM dionysus_outbox_without_changesets o
    LEFT JOIN accounts a ON o.resource_class = 'Account' AND o.resource_id = a.synced_id::VARCHAR"""
)
def resource_age_order(spark, sf_dir):
    """T-02: the time by which rows are published after a commit, their resource's creation if it is known."""
    resources = table(spark, sf_dir, "accounts").select(
        F.lit("Account").alias("resource_class"), F.col("synced_id").cast("string").alias("resource_id"), F.col("synced_created_at").alias("resource_created_at")
    )
    return outbox.by_resource_age(table(spark, sf_dir, OUTBOX), resources).select("id", "updated_at", "loaded_at", "age_at")


_MODEL = "CASE lower(trim(model_name)) " + " ".join(f"WHEN '{m.lower()}' THEN '{m}'" for m in wire.MODELS) + " END"
_KIND = "CASE WHEN event LIKE '%created' THEN 'created' WHEN event LIKE '%updated' THEN 'updated' WHEN event LIKE '%destroyed' THEN 'destroyed' END"
_TOPICS = ", ".join(f"('{m}', '{s.resource}', '{t}')" for m, s in REGISTRY.models.items() for t in REGISTRY.outbox_topics(m))


@query(
    f"""SELECT arrival_no, d.model AS resource_class, resource || '_' || kind AS event_name, topic, CASE WHEN topic = '__outbox_observer__' THEN '[' || arrival_no || ']' END AS changeset
    FROM (SELECT arrival_no, {_MODEL} AS model, {_KIND} AS kind FROM deserialized_records) d JOIN (VALUES {_TOPICS}) t(model, resource, topic) ON t.model = d.model WHERE kind IS NOT NULL"""
)
def topic_fanout(spark, sf_dir):
    """K-02, U-02, P-11, J-06, F-16: outbox rows of every change, one per topic that needs it; only the observers' row keeps the changeset."""
    feed = table(spark, sf_dir, "deserialized_records")
    changes = feed.select(
        wire.model_name(F.col("model_name"), wire.MODELS).alias("model"),
        F.col("arrival_no").alias("id"),
        wire.event_kind(F.col("event")).alias("kind"),
        F.col("synced_account_id").cast("string").alias("partition_key"),
        F.concat(F.lit("["), F.col("arrival_no"), F.lit("]")).alias("changeset"),
    ).where("model is not null and kind is not null")
    rows = outbox.insert(changes, REGISTRY, _now())
    return rows.select(F.col("resource_id").cast("bigint").alias("arrival_no"), "resource_class", "event_name", "topic", "changeset")


_MAPPING = ", ".join(f"('{ns}', '{t}', '{m}', '{','.join(e)}')" for ns, t, m, e in REGISTRY.mapping())


@query(f"SELECT * FROM (VALUES {_MAPPING}) v(namespace, topic, model, embeds)")
def topics_models_mapping(spark, sf_dir):
    """A-09: topics, the models that they publish, and what these embed."""
    return spark.createDataFrame([(ns, t, m, ",".join(e)) for ns, t, m, e in REGISTRY.mapping()], "namespace string, topic string, model string, embeds string")


# --- changes -------------------------------------------------------------------------------------

_ID = "CASE WHEN try_cast(trim(synced_id) AS DECIMAL(38,6)) = floor(try_cast(trim(synced_id) AS DECIMAL(38,6))) THEN try_cast(try_cast(trim(synced_id) AS DECIMAL(38,6)) AS BIGINT) END"
_LOG = f"""log AS (SELECT arrival_no, {_MODEL} AS model, {_ID} AS id, nullif(trim(synced_canceled_at), '') AS canceled, synced_account_id AS account_id, name,
    event LIKE '%destroyed' AS gone FROM deserialized_records),
  seen AS (SELECT *, row_number() OVER w = 1 AS is_first, lag(canceled) OVER w AS old_canceled, lag(account_id) OVER w AS old_account_id, lag(name) OVER w AS old_name
    FROM log WHERE model IS NOT NULL AND id IS NOT NULL WINDOW w AS (PARTITION BY model, id ORDER BY arrival_no))"""


def _log(spark, sf_dir):
    feed = table(spark, sf_dir, "deserialized_records")
    log = feed.select(
        "arrival_no",
        wire.model_name(F.col("model_name"), wire.MODELS).alias("model"),
        wire.whole_number(F.col("synced_id")).alias("id"),
        wire.text(F.col("synced_canceled_at")).alias("canceled"),
        F.col("synced_account_id").alias("account_id"),
        "name",
        F.col("event").endswith("destroyed").alias("gone"),
    ).where("model is not null and id is not null")
    return classify.with_previous(log, ["model", "id"], ["arrival_no"], ["canceled", "account_id", "name"], block=F.floor(F.col("arrival_no") / (1 << 20)))


_KINDS = """CASE WHEN gone THEN 'destroyed' WHEN is_first THEN 'created' WHEN old_canceled IS NOT NULL AND canceled IS NULL THEN 'created'
    WHEN canceled IS NOT NULL AND canceled IS DISTINCT FROM old_canceled THEN 'destroyed' WHEN canceled IS NULL THEN 'updated'"""


@query(f"WITH {_LOG} SELECT arrival_no, {_KINDS} END AS kind FROM seen")
def soft_delete_events(spark, sf_dir):
    """W-04, F-14, F-15: event of every version from the soft-delete stamp before and after it."""
    kind = classify.transition(F.col("old_canceled"), F.col("canceled"), F.col("is_first"), F.col("gone"))
    return _log(spark, sf_dir).select("arrival_no", kind.alias("kind"))


@query(f"WITH {_LOG} SELECT arrival_no, {_KINDS} ELSE 'updated' END AS kind FROM seen")
def update_after_soft_delete(spark, sf_dir):
    """W-04 for models that publish updates after a soft delete."""
    kind = classify.transition(F.col("old_canceled"), F.col("canceled"), F.col("is_first"), F.col("gone"), after_soft_delete=True)
    return _log(spark, sf_dir).select("arrival_no", kind.alias("kind"))


@query(
    f"""WITH {_LOG}
    SELECT arrival_no, 'account_id' AS attr, old_account_id::VARCHAR AS old, account_id::VARCHAR AS new FROM seen WHERE account_id IS DISTINCT FROM old_account_id
    UNION ALL SELECT arrival_no, 'name', old_name, name FROM seen WHERE name IS DISTINCT FROM old_name
    UNION ALL SELECT arrival_no, 'canceled', old_canceled, canceled FROM seen WHERE canceled IS DISTINCT FROM old_canceled"""
)
def changeset_diff(spark, sf_dir):
    """A-08, P-13, F-13, D8: changed attributes of every version, before and after; versions without any change vanish."""
    return classify.long_changes(_log(spark, sf_dir), ["arrival_no"], ["account_id", "name", "canceled"])


@query(f"WITH {_LOG} SELECT arrival_no FROM seen WHERE NOT is_first AND (name IS DISTINCT FROM old_name OR account_id IS DISTINCT FROM old_account_id) AND model = 'Client'")
def observes_attributes(spark, sf_dir):
    """F-17, U-03: changes of clients that touch an observed attribute."""
    changed = classify.changeset(["account_id", "name", "canceled"])
    rows = _log(spark, sf_dir).where("model = 'Client' and not is_first").withColumn("changeset", changed)
    return rows.where(fanout.observes(F.col("changeset"), ["name", "account_id"])).select("arrival_no")


@query(
    f"""WITH {_LOG} SELECT arrival_no, (account_id IS DISTINCT FROM old_account_id)::INT + (name IS DISTINCT FROM old_name)::INT + (canceled IS DISTINCT FROM old_canceled)::INT AS n_changed
    FROM seen WHERE model = 'Tax'"""
)
def changeset_encrypted(spark, sf_dir):
    """P-14, D7: changesets of taxes through AES and back."""
    return _unsealed(_log(spark, sf_dir).where("model = 'Tax'"))


@query(
    f"""WITH {_LOG} SELECT arrival_no, model, (account_id IS DISTINCT FROM old_account_id)::INT + (name IS DISTINCT FROM old_name)::INT + (canceled IS DISTINCT FROM old_canceled)::INT AS n_changed
    FROM seen"""
)
def changeset_encrypted_all(spark, sf_dir):
    """P-14, D7: changesets of all models through AES and back."""
    return _unsealed(_log(spark, sf_dir), "model")


def _unsealed(log, *columns):
    key = F.lit("0123456789abcdef")
    sealed = log.withColumn("cipher", classify.encrypted(F.to_json(classify.changeset(["account_id", "name", "canceled"])), key))
    opened = F.from_json(classify.decrypted(F.col("cipher"), key), "map<string,string>")
    return sealed.select("arrival_no", *columns, F.size(opened).alias("n_changed"))


# --- messages out of records ---------------------------------------------------------------------


def _aggregates(spark, sf_dir, embed):
    tables = {"customer": (table(spark, sf_dir, "customer"), CUSTOMER), "lines": (table(spark, sf_dir, "lineitem"), LINE)}
    return snapshot.aggregate(table(spark, sf_dir, "orders"), ORDER, tables, embed)


@query(
    """SELECT o_orderkey, c_mktsegment, coalesce(n, 0) AS n_lines, round(coalesce(q, 0), 2) AS quantity FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
)
def aggregate_root(spark, sf_dir):
    """J-01, P-01, P-04: orders with their customer and lines embedded; here what lies in the nested record."""
    found = _aggregates(spark, sf_dir, ("customer", "lines"))
    total = F.aggregate("record.lines", F.lit(0.0), lambda s, x: s + x["l_quantity"])
    return found.select(
        F.col("key").alias("o_orderkey"), F.col("record.customer.c_mktsegment").alias("c_mktsegment"), F.size("record.lines").cast("bigint").alias("n_lines"), F.round(total, 2).alias("quantity")
    )


@query(
    """SELECT o_orderkey, o_custkey AS customer, coalesce(ids, '') AS lines FROM orders
    LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
)
def links_ids(spark, sf_dir):
    """P-02, P-03, A-06, T-03: links of every order, to-many ones sorted."""
    links = F.col("record.links")
    return _aggregates(spark, sf_dir, ()).select(F.col("key").alias("o_orderkey"), links["customer"].alias("customer"), F.concat_ws(",", links["lines"].cast("array<string>")).alias("lines"))


@query(
    """SELECT o_orderkey, 'Order:' || o_orderkey AS key, o_custkey::VARCHAR AS partition_key, 'order_updated' AS event, 'Order' AS model, o_orderkey AS id, o_orderstatus AS status,
      o_custkey AS customer, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey"""
)
def message_roundtrip(spark, sf_dir):
    """P-08, P-09, P-10, D2, C-01: messages written as JSON text and read again."""
    found = _aggregates(spark, sf_dir, ("lines",)).withColumn("account_id", F.col("record.links.customer"))
    sent = found.select(
        F.col("key").alias("o_orderkey"),
        naming.message_key("Order", F.col("key")).alias("key"),
        snapshot.partition_key(found, REGISTRY.topics[1]).alias("partition_key"),
        snapshot.envelope(naming.event_name("order", "updated"), F.lit("Order"), snapshot.to_json(F.col("record"))).alias("value"),
    )
    read = decode.canonical(decode.records(decode.events(sent, "value")))
    get = lambda k, t: F.try_variant_get(F.col("attributes")[k], "$", t)
    lines = F.filter("has_many", lambda r: r["name"] == "lines")[0]["records"]
    return read.select(
        "o_orderkey", "key", "partition_key", "event", F.col("model_name").alias("model"), get("synced_id", "bigint").alias("id"), get("o_orderstatus", "string").alias("status"),
        get("synced_customer_id", "bigint").alias("customer"), F.size(lines).cast("bigint").alias("n_lines"),
    )


_NOW_ROWS = """SELECT o.id, o.updated_at, o.loaded_at, o.event_name, a.synced_id IS NOT NULL AS found FROM dionysus_outbox_without_changesets o
    LEFT JOIN accounts a ON o.resource_id = a.synced_id::VARCHAR WHERE o.resource_class = 'Account'"""


def _accounts_now(spark, sf_dir):
    snapshots = table(spark, sf_dir, "accounts").select(
        F.lit("Account").alias("resource_class"), F.col("synced_id").cast("string").alias("resource_id"), snapshot.to_json(F.struct(F.col("synced_id").alias("id"), "name")).alias("record")
    )
    return table(spark, sf_dir, OUTBOX).where("resource_class = 'Account'"), snapshots


@query(
    f"SELECT id, updated_at, loaded_at, found, CASE WHEN NOT found THEN 0 END AS n_links FROM ({_NOW_ROWS}) q WHERE found OR event_name LIKE '%destroyed'"
)
def deleted_snapshot(spark, sf_dir):
    """J-04, S-12, P-06, F-04: outbox rows with their record as it is now; a destroyed one that is gone has id and empty links."""
    rows, snapshots = _accounts_now(spark, sf_dir)
    now = snapshot.current(rows, snapshots).withColumn("record", F.coalesce("record", snapshot.deleted(F.col("resource_id"))))
    links = F.size(F.from_json(F.get_json_object("record", "$.links"), "map<string,string>")).cast("int")
    return now.select("id", "updated_at", "loaded_at", F.col("exists").alias("found"), F.when(~F.col("exists"), links).alias("n_links"))


@query(f"SELECT id, updated_at, loaded_at FROM ({_NOW_ROWS}) q WHERE NOT found AND event_name NOT LIKE '%destroyed'")
def vanished_rows(spark, sf_dir):
    """F-04: created and updated rows whose record is gone."""
    return snapshot.vanished(*_accounts_now(spark, sf_dir)).select("id", "updated_at", "loaded_at")


@query("SELECT o_orderkey, 'order:' || o_orderkey AS key, coalesce(try_cast(o_orderpriority AS BIGINT), 0)::VARCHAR AS partition_key FROM orders")
def partition_keys(spark, sf_dir):
    """P-09, P-10, Q-10: an attribute that is no number gives "0"."""
    return table(spark, sf_dir, "orders").select("o_orderkey", naming.message_key("order", F.col("o_orderkey")).alias("key"), naming.partition_key(F.col("o_orderpriority")).alias("partition_key"))


@query(
    "SELECT message_id, t AS topic FROM messages, (VALUES ('v3_rentals'), ('v3_rentals_genesis')) v(t) WHERE topic = 'v3_rentals'"
)
def genesis_replica(spark, sf_dir):
    """K-01, K-11, P-12: every message of a topic with replica goes out twice."""
    rows = table(spark, sf_dir, "messages").where("topic = 'v3_rentals'").select("message_id", "partition_key", F.col("message_key").alias("key"))
    return snapshot.routed(rows, REGISTRY.topics[0]).select("message_id", "topic")


@query("SELECT topic, count(*) AS n FROM messages WHERE message_value IS NULL OR trim(message_value) = 'null' GROUP BY topic")
def tombstones(spark, sf_dir):
    """K-12, F-21, Q-02: tombstones per topic."""
    return table(spark, sf_dir, "messages").where(snapshot.is_tombstone(F.col("message_value"))).groupBy("topic").agg(F.count("*").alias("n"))


# --- fan-out -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def dependency_parents(spark, sf_dir):
    """J-02, W-05: orders that a change of one of their lines publishes again, once each."""
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return fanout.parents(changed, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    """SELECT r_regionkey, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"""
)
def observer_chain(spark, sf_dir):
    """J-03: orders reached from regions over nations and customers."""
    hops = [(table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey"), (table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey"), (table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")]
    return fanout.follow(table(spark, sf_dir, "region"), hops).select("r_regionkey", "o_orderkey")


@query(
    """SELECT n_nationkey, count(*) AS n_observers, CASE WHEN count(*) > 1000 THEN 'replay' ELSE 'inline' END AS route FROM nation
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def observer_fanout(spark, sf_dir):
    """J-03, R-17, A-04: observers per change, and whether they are too many to be published inline."""
    hops = [(table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey"), (table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")]
    return fanout.route(fanout.follow(table(spark, sf_dir, "nation"), hops), ["n_nationkey"])


# --- replay --------------------------------------------------------------------------------------


@query(
    """SELECT record_no, CASE WHEN canceled_at IS NULL THEN 'updated' ELSE 'destroyed' END AS kind FROM serialized_records
    WHERE updated_at BETWEEN TIMESTAMP '2025-02-01' AND TIMESTAMP '2025-05-01' AND model_name IN ('Rental', 'Client') AND topic = 'v3_rentals'"""
)
def genesis_scan(spark, sf_dir):
    """S-03, S-04, S-06, P-11: records to replay, and as what."""
    rows = genesis.scan(
        table(spark, sf_dir, "serialized_records"), start=dt.datetime(2025, 2, 1), end=dt.datetime(2025, 5, 1), soft_delete="canceled_at", where={"model_name": ["Rental", "Client"], "topic": "v3_rentals"}
    )
    return rows.select("record_no", genesis.kind(F.col("canceled_at")).alias("kind"))


@query("SELECT record_no FROM serialized_records WHERE canceled_at IS NULL AND links IS NULL")
def genesis_visible(spark, sf_dir):
    """S-05, S-06, F-14: visible records only; a condition of None means null."""
    return genesis.scan(table(spark, sf_dir, "serialized_records"), soft_delete="canceled_at", visible_only=True, where={"links": None}).select("record_no")


@query(
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders)
    SELECT CAST(floor(n / 1000) AS BIGINT) AS batch_no, count(*) AS n_ids, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id,
      CAST(floor(n / 1000) AS BIGINT) * CAST(floor(86400 * 1.5 / ceil(any_value(total) / 1000)) AS BIGINT) AS delay_s FROM n GROUP BY floor(n / 1000)"""
)
def genesis_schedule(spark, sf_dir):
    """S-07, W-02, A-06, T-03, R-15: batches of sorted ids and when they run."""
    jobs = genesis.batched(table(spark, sf_dir, "orders"), "o_orderkey", days=1.5, spread=1 << 14)
    return jobs.select("batch_no", F.size("ids").cast("bigint").alias("n_ids"), F.col("ids")[0].alias("first_id"), F.array_max("ids").alias("last_id"), "delay_s")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) q WHERE n <= 1000)")
def genesis_rescan(spark, sf_dir):
    """S-08, J-09: rows of the first job."""
    orders = table(spark, sf_dir, "orders")
    first = genesis.batched(orders, "o_orderkey", days=1.5, spread=1 << 14).where("batch_no = 0")
    return genesis.rescan(orders, first, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch_no, o_orderkey, o_totalprice FROM orders")
def genesis_rescan_all(spark, sf_dir):
    """S-08, J-09: rows of every job."""
    orders = table(spark, sf_dir, "orders")
    jobs = genesis.batched(orders, "o_orderkey", days=1.5, spread=1 << 14)
    return genesis.rescan_by_job(orders, jobs, "o_orderkey").select("batch_no", "o_orderkey", "o_totalprice")


# --- messages to records -------------------------------------------------------------------------


@query("SELECT event_id, event_type, try_cast(props ->> '$.k' AS BIGINT) AS k FROM events")
def event_props_json(spark, sf_dir):
    """C-01: a field of JSON text through VARIANT."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(f"""WITH {_EVENTS} SELECT message_id, event_no::INT AS event_no, e ->> '$.event' AS event, e ->> '$.model_name' AS model_name FROM ev""")
def message_events(spark, sf_dir):
    """S-02, D2, D3, F-21: events of every message."""
    return decode.events(table(spark, sf_dir, "messages")).select("message_id", "event_no", "event", "model_name")


@query(
    f"""WITH {_RECORDS} SELECT message_id, event_no::INT AS event_no, record_no::INT AS record_no, r ->> '$.id' AS synced_id, json_exists(r, '$.canceled_at') AS has_canceled, r ->> '$.updated_at' AS updated_at,
      CASE WHEN json_type(r, '$.links.account') NOT IN ('OBJECT', 'ARRAY') THEN r ->> '$.links.account' END AS account_id,
      CASE WHEN json_type(r, '$.links.bookable') = 'OBJECT' THEN r ->> '$.links.bookable.type' END AS bookable_type,
      CASE WHEN json_type(r, '$.links.taxes') = 'ARRAY' THEN json_array_length(r, '$.links.taxes')::VARCHAR END AS n_taxes FROM rec WHERE json_type(r) = 'OBJECT'"""
)
def canonical_records(spark, sf_dir):
    """C-01 to C-06, D5, U-04: canonical attributes of every top record."""
    found = decode.canonical(decode.records(decode.events(table(spark, sf_dir, "messages").select("message_id", "message_value"))).where(F.try_variant_get("record", "$", "map<string,variant>").isNotNull()))
    get = lambda k: F.try_variant_get(F.col("attributes")[k], "$", "string")
    taxes = F.try_variant_get(F.col("attributes")["synced_tax_ids"], "$", "array<variant>")
    return found.select(
        "message_id", "event_no", "record_no", get("synced_id").alias("synced_id"), F.map_contains_key("attributes", F.lit("synced_canceled_at")).alias("has_canceled"),
        get("synced_updated_at").alias("updated_at"), get("synced_account_id").alias("account_id"), get("synced_bookable_type").alias("bookable_type"), F.size(taxes).cast("string").alias("n_taxes"),
    )


@query(
    f"""WITH {_MESSAGE} SELECT message_id FROM m WHERE message_value IS NOT NULL AND NOT coalesce(json_valid(message_value) AND trim(message_value) = 'null', false) AND msg IS NULL"""
)
def unreadable_messages(spark, sf_dir):
    """R-10: messages for the table of rejects."""
    return decode.unreadable(table(spark, sf_dir, "messages")).select("message_id")


_IGNORE = "CASE WHEN event LIKE '%preview%' OR event LIKE '%dry_run%' THEN 'rehearsal' WHEN synced_account_id IS NULL THEN 'no account' END"


@query(f"SELECT {_IGNORE} AS ignored_by, count(*) AS n FROM deserialized_records WHERE {_IGNORE} IS NOT NULL GROUP BY 1")
def message_filter(spark, sf_dir):
    """F-09: how many events each filter ignores; the first that does counts."""
    filters = [("rehearsal", F.col("event").contains("preview") | F.col("event").contains("dry_run")), ("no account", F.col("synced_account_id").isNull())]
    _, ignored = apply.split(table(spark, sf_dir, "deserialized_records"), filters)
    return ignored.groupBy("ignored_by").agg(F.count("*").alias("n"))


@query(
    f"""SELECT arrival_no, CASE WHEN kind = 'destroyed' THEN CASE WHEN has_key THEN 'assign' WHEN model = 'Rental' OR model = 'Booking' THEN 'cancel' ELSE 'destroy' END
      WHEN kind IN ('created', 'updated') THEN CASE WHEN has_key THEN 'assign' ELSE 'restore' END ELSE 'none' END AS action
    FROM (SELECT arrival_no, {_MODEL} AS model, {_KIND} AS kind, synced_canceled_at IS NOT NULL AS has_key FROM deserialized_records) q WHERE model IS NOT NULL"""
)
def delete_decision(spark, sf_dir):
    """R-06, F-05, F-06, F-10: what every event does to its record."""
    feed = table(spark, sf_dir, "deserialized_records").withColumn("model", wire.model_name(F.col("model_name"), wire.MODELS)).where("model is not null")
    kind = F.coalesce(wire.event_kind(F.col("event")), F.lit("other"))
    action = apply.delete_decision(kind, F.lit(True), F.col("model").isin("Rental", "Booking"), F.lit(True), F.col("synced_canceled_at").isNotNull())
    return feed.select("arrival_no", action.alias("action"))


def _target_and_incoming(spark, sf_dir):
    accounts = table(spark, sf_dir, "accounts").select("synced_id", F.col("synced_updated_at").alias("changed_at"), "name")
    shifted = accounts.where("synced_id % 3 <> 0").select(
        (F.col("synced_id") + 500).alias("synced_id"), F.when(F.col("synced_id") % 2 == 0, F.col("changed_at")).otherwise(F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")).alias("changed_at"), F.upper("name").alias("name")
    )
    return accounts, shifted


_INCOMING = "incoming AS (SELECT synced_id + 500 AS synced_id, CASE WHEN synced_id % 2 = 0 THEN synced_updated_at ELSE TIMESTAMP '2030-01-01' END AS changed_at, upper(name) AS name FROM accounts WHERE synced_id % 3 <> 0)"


@query(
    f"""WITH {_INCOMING}, target AS (SELECT synced_id, synced_updated_at AS changed_at, name FROM accounts)
    SELECT coalesce(t.synced_id, n.synced_id) AS synced_id, CASE WHEN take THEN n.changed_at ELSE t.changed_at END AS changed_at, CASE WHEN take THEN n.name ELSE t.name END AS name
    FROM (SELECT t.synced_id AS a, n.synced_id AS b, n.synced_id IS NOT NULL AND coalesce(n.changed_at >= t.changed_at, true) AS take FROM target t FULL JOIN incoming n USING (synced_id)) j
    LEFT JOIN target t ON t.synced_id = j.a LEFT JOIN incoming n ON n.synced_id = j.b"""
)
def upsert_merge(spark, sf_dir):
    """K-05, J-05: merge with the gate against the target's time."""
    target, incoming = _target_and_incoming(spark, sf_dir)
    return apply.upsert(target, incoming, ["synced_id"], "changed_at")


@query(
    f"""WITH {_INCOMING} SELECT synced_id, changed_at, name FROM incoming UNION ALL
    SELECT synced_id, synced_updated_at, name FROM accounts WHERE synced_id NOT IN (SELECT synced_id FROM incoming)"""
)
def bulk_import(spark, sf_dir):
    """K-06, Q-13: incoming rows replace the target's without any gate."""
    target, incoming = _target_and_incoming(spark, sf_dir)
    return apply.upsert(target, incoming, ["synced_id"])


@query(f"WITH {_INCOMING} SELECT synced_id FROM accounts WHERE synced_id NOT IN (SELECT synced_id FROM incoming)")
def bulk_destroy(spark, sf_dir):
    """K-07."""
    target, incoming = _target_and_incoming(spark, sf_dir)
    return apply.bulk_destroy(target, incoming, ["synced_id"]).select("synced_id")


@query(
    """SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 0 AND NOT EXISTS (
      SELECT 1 FROM lineitem k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_partkey = lineitem.l_partkey AND k.l_returnflag = 'N')"""
)
def prune_children(spark, sf_dir):
    """J-07, C-04: lines that the payload no longer lists; orders whose relation isn't embedded (odd ones) keep theirs."""
    lines = table(spark, sf_dir, "lineitem")
    payload = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("ids"))
    payload = payload.withColumn("ids", F.when(F.col("l_orderkey") % 2 == 0, F.col("ids")))
    return apply.prune_children(lines.select("l_orderkey", "l_partkey").distinct(), payload, "l_orderkey", "l_partkey")


@query("SELECT event_id, try_cast(props ->> '$.k' AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
def backfill_columns(spark, sf_dir):
    """C-40, S-13, C-10: columns out of the retained payload; a key that it lacks gives null."""
    return apply.backfill(table(spark, sf_dir, "events"), {"k": "bigint", "missing": "string"}, "props").select("event_id", "k", "missing")


_KEY_BATCH = "batch AS (SELECT *, offset_no // 2 AS b FROM m)"


@query(
    f"""WITH {_MESSAGE}, {_KEY_BATCH}, one AS (SELECT *, CASE WHEN json_type(msg) = 'ARRAY' THEN json_extract(msg, '$[0]') ELSE msg END AS e,
        CASE WHEN json_type(msg) = 'ARRAY' AND json_array_length(msg) = 1 THEN CASE json_type(json_extract(msg, '$[0].data')) WHEN 'ARRAY' THEN json_array_length(json_extract(msg, '$[0].data')) = 1 WHEN 'OBJECT' THEN true END END AS single FROM batch),
      data AS (SELECT *, bool_and(coalesce(single, false)) OVER (PARTITION BY topic, partition_no, b) AS applies, json_extract(e, '$.data') AS d FROM one),
      told AS (SELECT *, CASE json_type(d) WHEN 'ARRAY' THEN json_extract(d, '$[0]') ELSE d END AS r FROM data),
      keyed AS (SELECT message_id, topic, partition_no, b, applies, e ->> '$.event' AS event, lower(trim(e ->> '$.model_name')) AS model, {_ID.replace('synced_id', "(r ->> '$.id')")} AS id,
        epoch_us(try_cast((r ->> '$.updated_at') AS TIMESTAMPTZ)) AS t FROM told)
    SELECT message_id, message_id AS first_arrival FROM keyed WHERE NOT applies OR id IS NULL
    UNION ALL SELECT message_id, min(message_id) OVER w AS first_arrival FROM keyed WHERE applies AND id IS NOT NULL WINDOW w AS (PARTITION BY topic, partition_no, b, event, model, id)
    QUALIFY row_number() OVER (PARTITION BY topic, partition_no, b, event, model, id ORDER BY t DESC NULLS FIRST, CASE WHEN t IS NULL THEN -message_id ELSE message_id END) = 1"""
)
def dedupe_messages(spark, sf_dir):
    """R-02, R-03: repeated messages removed within batches (here: two offsets of a partition) where every message has one record."""
    rows = table(spark, sf_dir, "messages").withColumn("b", F.floor(F.col("offset_no") / 2))
    return apply.deduplicated(rows, ["topic", "partition_no", "b"], ["message_id"]).select("message_id", "first_arrival")


MAPPED = ModelSpec("Rental", ("title", "synced_account_id"), mapping={"title": "name"}, created_column="origin_created_at", updated_column="origin_updated_at", deleted_column=None)


def _utc(c: str) -> str:
    return f"epoch_us(try_cast(CASE WHEN regexp_matches(upper(trim({c})), '(Z|UTC|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ))"


def _time(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[0-9]+') THEN try_cast(trim({c}) AS BIGINT) * 1000 ELSE {_utc(c)} END"


@query(
    f"""WITH {_RECORDS}, top AS (SELECT *, r ->> '$.created_at' AS c, r ->> '$.updated_at' AS u, r ->> '$.id' AS raw_id FROM rec WHERE json_type(r) = 'OBJECT')
    SELECT message_id, event_no::INT AS event_no, record_no::INT AS record_no, {_ID.replace('synced_id', 'raw_id')} AS synced_id, r ->> '$.name' AS title,
      CASE WHEN json_type(r, '$.links.account') = 'OBJECT' THEN r ->> '$.links.account.id' WHEN json_type(r, '$.links.account') <> 'ARRAY' THEN r ->> '$.links.account' END AS synced_account_id,
      {_time('c')} AS origin_created_at, {_time('u')} AS origin_updated_at FROM top"""
)
def mapped_columns(spark, sf_dir):
    """C-07, C-08, C-09: top records as rows of a local table with a mapped attribute, times under other names, no soft-delete column, and nothing that the model doesn't declare."""
    found = decode.records(decode.events(table(spark, sf_dir, "messages").select("message_id", "message_value")))
    found = decode.canonical(found.where(F.try_variant_get("record", "$", "map<string,variant>").isNotNull()))
    text = lambda k: F.try_variant_get(F.col("attributes")[k], "$", "string")
    rows = found.select(
        "message_id", "event_no", "record_no", wire.whole_number(text("synced_id")).alias("synced_id"), wire.epoch_us(text("synced_created_at")).alias("created_us"),
        wire.epoch_us(text("synced_updated_at")).alias("updated_us"), wire.epoch_us(text("synced_canceled_at")).alias("canceled_us"), snapshot.to_json(F.col("attributes")).alias("synced_data"),
    )
    return apply.local_table(rows, MAPPED, keep=("message_id", "event_no", "record_no"))


@query(
    f"""WITH {_RECORDS}, links AS (SELECT message_id, event_no, record_no, r, unnest(json_keys(json_extract(r, '$.links'))) AS k FROM rec WHERE json_type(r) = 'OBJECT' AND json_type(json_extract(r, '$.links')) = 'OBJECT'),
      one AS (SELECT *, json_extract(r, '$.links."' || k || '"') AS l, json_extract(r, '$."' || k || '"') AS v FROM links),
      inner_ AS (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[0]') ELSE v END AS c FROM one WHERE json_type(l) <> 'ARRAY')
    SELECT message_id, event_no::INT AS event_no, record_no::INT AS record_no, CASE WHEN json_type(l) = 'OBJECT' THEN coalesce(l ->> '$.type', k) ELSE k END AS name, c ->> '$.id' AS child_id
    FROM inner_ WHERE json_type(c) = 'OBJECT'"""
)
def has_one_records(spark, sf_dir):
    """C-05, C-06: records embedded as to-one relations, named by the link's type where it has one."""
    found = decode.canonical(decode.records(decode.events(table(spark, sf_dir, "messages").select("message_id", "message_value"))).where(F.try_variant_get("record", "$", "map<string,variant>").isNotNull()))
    inner = decode.children(found, ["message_id", "event_no", "record_no"]).where("not to_many")
    return inner.select("message_id", "event_no", "record_no", "name", F.try_variant_get("record", "$.id", "string").alias("child_id"))


@query(
    """SELECT o_orderkey, c_custkey AS customer_id, c_name AS customer_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON c_custkey = o_custkey"""
)
def resolve_to_one(spark, sf_dir):
    """J-08: the local row that a to-one link names; null where it isn't there."""
    there = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    orders = apply.resolve_to_one(table(spark, sf_dir, "orders"), "o_custkey", there, "c_custkey", "customer_id")
    return apply.resolve_to_one(orders, "o_custkey", there, "c_custkey", "customer_name", "c_name").select("o_orderkey", "customer_id", "customer_name")


@query("SELECT id, updated_at, loaded_at, resource_class || ':' || resource_id AS key, NULL::VARCHAR AS value FROM dionysus_outbox_without_changesets WHERE event_name LIKE '%destroyed'")
def tombstone_messages(spark, sf_dir):
    """K-12: a null message under the key of every record that was destroyed."""
    gone = table(spark, sf_dir, OUTBOX).where(F.col("event_name").endswith("destroyed"))
    keys = gone.select("id", "updated_at", "loaded_at", F.concat_ws(":", "resource_class", "resource_id").alias("key"))
    return snapshot.tombstones(keys)


@query(
    """SELECT message_id, topic FROM messages UNION ALL SELECT message_id, topic || '_genesis' FROM messages WHERE topic = 'v3_rentals'"""
)
def genesis_replica_all(spark, sf_dir):
    """K-01, K-11, P-12: messages of all topics, those of a topic with replica twice."""
    rows = table(spark, sf_dir, "messages").select("message_id", "partition_key", F.col("message_key").alias("key"), F.col("topic").alias("own"))
    replicas = {t.full_name: t for t in REGISTRY.topics if t.genesis_replica}
    out = rows.where(~F.col("own").isin(*replicas)).select("message_id", F.col("own").alias("topic"))
    for name, topic in replicas.items():
        out = out.unionByName(snapshot.routed(rows.where(F.col("own") == name), topic).select("message_id", "topic"))
    return out


@query(
    """SELECT record_no, CASE WHEN canceled_at IS NULL THEN 'rental_updated' ELSE 'rental_destroyed' END AS event_name, t AS topic
    FROM serialized_records, (VALUES ('v3_rentals'), ('v3_rentals_genesis')) v(t) WHERE model_name = 'Rental' AND updated_at BETWEEN TIMESTAMP '2025-01-01' AND TIMESTAMP '2025-06-01'"""
)
def genesis_replay(spark, sf_dir):
    """F-18, F-19, S-03 to S-06, K-11: a replay that the registry allows, for the topic and its replica."""
    models = {**REGISTRY.models, "Rental": dataclasses.replace(REGISTRY.models["Rental"], soft_delete_column="canceled_at")}
    found = genesis.replay(
        table(spark, sf_dir, "serialized_records").drop("topic"), Registry(models, REGISTRY.topics), REGISTRY.topics[0], "Rental", start=dt.datetime(2025, 1, 1), end=dt.datetime(2025, 6, 1), where={"model_name": "Rental"}
    )
    return found.select("record_no", "event_name", "topic")


@query(f"WITH {_LOG} SELECT arrival_no, model FROM seen WHERE NOT is_first AND (name IS DISTINCT FROM old_name OR account_id IS DISTINCT FROM old_account_id)")
def observes_attributes_all(spark, sf_dir):
    """F-17, U-03: changes of all models that touch an observed attribute."""
    rows = _log(spark, sf_dir).where("not is_first").withColumn("changeset", classify.changeset(["account_id", "name", "canceled"]))
    return rows.where(fanout.observes(F.col("changeset"), ["name", "account_id"])).select("arrival_no", "model")


@query(
    f"""WITH {pipeline._CHANGES}, here AS (SELECT model_name AS c, synced_id::VARCHAR AS i FROM ({pipeline._PRESENT}) p UNION ALL SELECT 'Account', synced_id::VARCHAR FROM accounts)
    SELECT id, updated_at, loaded_at, resource_class, i IS NOT NULL AS found FROM dionysus_outbox_without_changesets LEFT JOIN here ON c = resource_class AND i = resource_id
    WHERE i IS NOT NULL OR event_name LIKE '%destroyed'"""
)
def current_rows(spark, sf_dir):
    """J-04, S-12, F-04: outbox rows of all models with their record as it is now, by class and id."""
    own = pipeline.p2_found(spark, sf_dir).select(F.col("model_name").alias("resource_class"), F.col("synced_id").cast("string").alias("resource_id"))
    accounts = table(spark, sf_dir, "accounts").select(F.lit("Account").alias("resource_class"), F.col("synced_id").cast("string").alias("resource_id"))
    here = own.unionByName(accounts).withColumn("record", snapshot.to_json(F.struct(F.col("resource_id").alias("id"))))
    return snapshot.current(table(spark, sf_dir, OUTBOX), here).select("id", "updated_at", "loaded_at", "resource_class", F.col("exists").alias("found"))


@query(
    """WITH n AS (SELECT l_orderkey AS k, max(l_shipdate) AS moment, 'S' AS status FROM lineitem GROUP BY 1)
    SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NOT NULL AND coalesce(moment >= o_orderdate, true) THEN moment ELSE o_orderdate END AS o_orderdate,
      CASE WHEN k IS NOT NULL AND coalesce(moment >= o_orderdate, true) THEN status ELSE o_orderstatus END AS o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN n ON k = o_orderkey"""
)
def upsert_orders(spark, sf_dir):
    """K-05, J-05 on growing tables: orders merged with what their lines tell, by the gate."""
    incoming = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("o_orderdate")).withColumn("o_orderstatus", F.lit("S"))
    target = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return apply.upsert(target, incoming, ["o_orderkey"], "o_orderdate")


CONSUMER = [ModelSpec(m, soft_delete=m not in ("Client", "Tax")) for m in ("Booking", "Rental", "BookingsFee", "Client", "Fee", "Tax", "Account")]


@query()
def consumer_state(spark, sf_dir):
    """The whole consumer over all messages (F-05 to F-10, C-01 to C-10, R-06, K-05): tables after the last message.

    A fold with deletes that reset the gate has no SQL; the tests hold it against a sequential replay.
    """
    state, _, _ = apply.consume(table(spark, sf_dir, "messages"), ["message_id"], CONSUMER)
    return state


@query()
def change_feed(spark, sf_dir):
    """K-08, K-09, A-07, C-11: changed attributes of all records in all messages, embedded ones with their roots."""
    _, feed, _ = apply.consume(table(spark, sf_dir, "messages"), ["message_id"], CONSUMER)
    return apply.local_changes(feed)


@query()
def change_events(spark, sf_dir):
    """K-08, A-07, C-11: one event per applied root record, with the changes of all records that came in it."""
    _, feed, _ = apply.consume(table(spark, sf_dir, "messages"), ["message_id"], CONSUMER)
    return apply.root_events(feed, ["message_id"])


@query()
def local_rentals(spark, sf_dir):
    """C-07 to C-10: the consumer's rentals as rows of a local table with a mapped attribute and times under other names."""
    state, _, _ = apply.consume(table(spark, sf_dir, "messages"), ["message_id"], CONSUMER)
    return apply.local_table(state.where("model = 'Rental'"), MAPPED)


@query()
def consumer_rejects(spark, sf_dir):
    """R-10, F-07: what couldn't be applied, and why."""
    _, _, rejects = apply.consume(table(spark, sf_dir, "messages"), ["message_id"], CONSUMER)
    return rejects


# --- monitoring extras ---------------------------------------------------------------------------


@query(
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s"""
)
def event_sessions(spark, sf_dir):
    """R-19, an extra: sessions of a user with gaps under 12 hours."""
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


@query(
    """SELECT topic, epoch_us(min(began_at)) AS lo FROM outbox_runs WHERE outcome = 'succeeded' GROUP BY topic"""
)
def first_runs(spark, sf_dir):
    """R-12: the first succeeded poll of every topic, from the intervals that the runs committed."""
    runs = table(spark, sf_dir, "outbox_runs").select("run_no", "topic", wire.us_of(F.col("began_at")).alias("at"), "outcome")
    return incremental.gaps(runs).groupBy("topic").agg(F.min("hi").alias("lo"))
