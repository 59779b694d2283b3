"""Queries of the general data-pipeline problems (p1 to p5) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.functions.naming import underscore
from weirflow.operators import incremental, nested, once, orphans, replay
from weirflow.sources.tables import OUTBOX, table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, accounts = table(spark, sf_dir, "deserialized_records"), table(spark, sf_dir, "accounts")
    parents = orphans.feed_changes(feed).unionByName(orphans.account_changes(accounts))
    return orphans.orphans(orphans.references(table(spark, sf_dir, "serialized_records")), parents)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("record_no", "relation", "target_id")


def p1_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.by_period(_orphans(spark, sf_dir))


_P2_KEYS, _P2_COLUMNS = ["model_name", "synced_id"], ["synced_account_id", "created_us", "name"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = replay.feed_changes(table(spark, sf_dir, "deserialized_records"), [*_P2_KEYS, "seq", "gone"])
    stands = replay.present(replay.replay(changes, _P2_KEYS, []), _P2_KEYS, [])
    return stands.select(*_P2_KEYS, F.shiftright("seq", 1).alias("version_us"))


def p2_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present table with its columns: each has the value that the latest change naming it gave it, also one before a removal (see p2_table)."""
    states = replay.replay(replay.feed_changes(table(spark, sf_dir, "deserialized_records")), _P2_KEYS, _P2_COLUMNS)
    stands = replay.present(states, _P2_KEYS, _P2_COLUMNS, clear=False)
    numbers = [F.col(c).cast("string").alias(c) for c in _P2_COLUMNS]  # as text: clients disagree on whole numbers with nulls
    return stands.select(*_P2_KEYS, F.shiftright("seq", 1).alias("version_us"), *numbers)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nested.label(table(spark, sf_dir, "messages"), payload=False)
    return nested.link(nodes).select("message_id", "parent_path", "record_path")


def p3_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its ids, links and attributes; rows of one model_name are that model's table."""
    return nested.label(table(spark, sf_dir, "messages"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records by id and relation, with the id of the record that they lie in."""
    found = nested.link(nested.label(table(spark, sf_dir, "messages")))
    return found.select("message_id", "record_path", "relation", "record_id", "parent_id", "depth")


# The links to one record that each model has in messages.
NODE_LINKS = {
    "Rental": ("account", "fee"), "Booking": ("client", "rental"), "Client": ("account",), "BookingsFee": ("fee",), "Tax": ("account",), "Fee": ("rentals_fee",), "Account": (),
}


def _node_table(model: str):
    def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.node_table(nested.label(table(spark, sf_dir, "messages")), model, {"name": "string"}, NODE_LINKS[model])

    p3_table.__doc__ = f"Flat table of {model}, with the record that each one lies in."
    p3_table.__name__ = f"p3_table_{underscore(model)}"
    return p3_table


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present table with its columns as a removal leaves them: a value counts only if it was set after the record's last removal."""
    states = replay.replay(replay.feed_changes(table(spark, sf_dir, "deserialized_records")), _P2_KEYS, _P2_COLUMNS)
    stands = replay.present(states, _P2_KEYS, _P2_COLUMNS)
    numbers = [F.col(c).cast("string").alias(c) for c in _P2_COLUMNS]
    return stands.select(*_P2_KEYS, F.shiftright("seq", 1).alias("version_us"), *numbers)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.due(table(spark, sf_dir, OUTBOX), table(spark, sf_dir, "outbox_runs")).select("run_no", "outbox_id")


def p4_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each succeeded run processes; runs with nothing to do are left out."""
    return p4_found(spark, sf_dir).groupBy("run_no").agg(F.count("*").alias("n_rows"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, version = wire.whole_number(F.col("synced_id")), wire.epoch_us(F.col("synced_updated_at"))
    identified = F.col("synced_id").isNotNull() & F.col("synced_updated_at").isNotNull()
    feed = table(spark, sf_dir, "deserialized_records")
    # Computed once, and not again for every use in the plans below.
    feed = feed.select(
        "arrival_no",
        "batch_no",
        F.concat_ws(":", wire.model_key(F.col("model_name")), number.cast("string")).alias("producer"),
        F.when(number.isNotNull(), version).alias("number"),
        F.when(
            wire.text(F.col("synced_id")).isNotNull() & wire.text(F.col("synced_updated_at")).isNotNull() & identified,
            F.to_json(F.array(wire.model_key(F.col("model_name")), wire.text(F.col("synced_id")), wire.text(F.col("synced_updated_at")))),
        ).alias("exact"),
    )
    accepted, _ = once.accept_in_parts(feed, F.col("producer"), F.col("number"), F.col("exact"), "arrival_no", "batch_no")
    return once.duplicates(feed, accepted, "arrival_no")


def p5_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen ranges per record after the whole feed, as the next batch would get them."""
    feed = table(spark, sf_dir, "deserialized_records").select(
        "arrival_no",
        F.concat_ws(":", wire.model_key(F.col("model_name")), wire.whole_number(F.col("synced_id")).cast("string")).alias("producer"),
        F.when(wire.whole_number(F.col("synced_id")).isNotNull(), wire.epoch_us(F.col("synced_updated_at"))).alias("number"),
    )
    _, ranges = once.accept(feed, F.col("producer"), F.col("number"), F.lit(None).cast("string"), "arrival_no")
    return ranges.select("producer", "lo", "hi")


_NODE_TABLES = [_node_table(m) for m in NODE_LINKS]
QUERIES = {q.__name__: q for q in (p1_found, p1_by_month, p2_found, p2_present, p2_table, *_NODE_TABLES, p3_found, p3_links, p3_tables, p4_found, p4_per_run, p5_found, p5_seen)}

# --- the same in SQL -----------------------------------------------------------------------------


def _us(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim({c}), '[0-9]+') THEN try_cast(trim({c}) AS BIGINT) * 1000"
        f" ELSE epoch_us(try_cast(CASE WHEN regexp_matches(upper(trim({c})), '(Z|UTC|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ)) END"
    )


def _id(c: str) -> str:
    return f"CASE WHEN try_cast(trim({c}) AS DECIMAL(38,6)) = floor(try_cast(trim({c}) AS DECIMAL(38,6))) THEN try_cast(try_cast(trim({c}) AS DECIMAL(38,6)) AS BIGINT) END"


_MODEL = "CASE lower(trim(model_name)) " + " ".join(f"WHEN '{m.lower()}' THEN '{m}'" for m in wire.MODELS) + " END"
_CHANGES = f"""changes AS (
  SELECT model, id, t, gone, received_at, synced_account_id, created_us, name FROM (
    SELECT {_MODEL} AS model, {_id('synced_id')} AS id, coalesce({_us('synced_updated_at')}, {_us('synced_created_at')}) AS t,
      (event LIKE '%destroyed' OR coalesce(trim(synced_canceled_at), '') <> '') AS gone, received_at,
      synced_account_id, {_us('synced_created_at')} AS created_us, nullif(trim(name), '') AS name
    FROM deserialized_records
    WHERE event LIKE '%created' OR event LIKE '%updated' OR event LIKE '%destroyed') c
  WHERE model IS NOT NULL AND id IS NOT NULL AND t IS NOT NULL)"""
_PRESENT = "SELECT model AS model_name, id AS synced_id, max(t) AS version_us FROM changes GROUP BY model, id HAVING NOT arg_max(gone, t * 2 + gone::INT)"

_LINKS = ", ".join(f"('{k}', '{v}')" for k, v in wire.LINK_MODELS.items())
_ORPHANS = f"""WITH {_CHANGES},
spans AS (
  SELECT model, id, received_at AS since, lead(received_at) OVER w AS until, gone FROM (
    SELECT model, id, received_at, (max(t * 2 + gone::INT) OVER (PARTITION BY model, id ORDER BY received_at)) % 2 = 1 AS gone FROM changes) s
  WINDOW w AS (PARTITION BY model, id ORDER BY received_at)
  UNION ALL
  SELECT 'Account', synced_id, synced_created_at, synced_canceled_at, false FROM accounts),
standing AS (SELECT * FROM spans WHERE NOT gone AND (until IS NULL OR until > since)),
whole AS (SELECT record_no, received_at, links FROM serialized_records WHERE json_valid(links) AND json_type(links) = 'OBJECT'),
pairs AS (SELECT record_no, received_at, k AS relation, json_extract(links, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(links)) AS k FROM whole) w),
named(relation, model) AS (VALUES {_LINKS}),
ids AS (
  SELECT record_no, received_at, relation, v ->> '$.type' AS model, v ->> '$.id' AS raw FROM pairs WHERE json_type(v) = 'OBJECT'
  UNION ALL
  SELECT record_no, received_at, relation, model, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN v ->> '$[*]' ELSE [v ->> '$'] END) FROM pairs JOIN named USING (relation) WHERE json_type(v) <> 'OBJECT'),
refs AS (SELECT DISTINCT record_no, received_at, relation, model, {_id('raw')} AS target_id FROM ids WHERE model IS NOT NULL),
orphans AS (
  SELECT * FROM refs WHERE target_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM standing s WHERE s.model = refs.model AND s.id = refs.target_id AND s.since <= refs.received_at AND (s.until IS NULL OR refs.received_at < s.until)))
"""

_VERSIONS = """versions AS (
  SELECT id, updated_at, min(loaded_at) AS landed, min(topic) AS topic, bool_or(published_at IS NOT NULL) AS published, max(retry_at) AS retry_at
  FROM dionysus_outbox_without_changesets GROUP BY id, updated_at),
spans AS (
  SELECT *, min(landed) OVER (PARTITION BY id ORDER BY updated_at DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until,
    CASE WHEN retry_at > landed THEN retry_at ELSE landed END AS ready FROM versions),
due AS (
  SELECT min_by(r.run_no, (r.began_at, r.run_no)) AS run_no, s.id AS outbox_id, s.updated_at
  FROM spans s JOIN outbox_runs r ON r.topic = s.topic AND r.outcome = 'succeeded' AND r.began_at >= s.ready AND (s.until IS NULL OR r.began_at < s.until)
  WHERE NOT s.published GROUP BY s.id, s.updated_at)"""

_NESTED = """WITH RECURSIVE texts AS (
      SELECT message_id, CASE WHEN json_valid(message_value) THEN CASE WHEN json_type(message_value) = 'VARCHAR' THEN message_value ->> '$' ELSE message_value END END AS v FROM messages),
    envelopes AS (SELECT message_id, json_extract(v, '$.message') AS m FROM texts WHERE json_valid(v) AND json_type(v) = 'OBJECT'),
    lists AS (SELECT message_id, CASE json_type(m) WHEN 'ARRAY' THEN json_extract(m, '$[*]') WHEN 'OBJECT' THEN [m] END AS l FROM envelopes),
    events AS (SELECT message_id, unnest(range(len(l))) AS e, unnest(l) AS x FROM lists WHERE l IS NOT NULL),
    datas AS (SELECT message_id, e, json_extract(x, '$.data') AS d FROM events WHERE json_type(x) = 'OBJECT'),
    datalists AS (SELECT message_id, e, CASE json_type(d) WHEN 'ARRAY' THEN json_extract(d, '$[*]') WHEN 'OBJECT' THEN [d] END AS l FROM datas),
    tops AS (SELECT message_id, e, unnest(range(len(l))) AS p, unnest(l) AS r FROM datalists WHERE l IS NOT NULL),
    records AS (
      SELECT message_id, NULL::VARCHAR AS parent_path, e || '/' || p AS record_path, r, NULL::VARCHAR AS k, NULL::VARCHAR AS parent_id, 0 AS depth FROM tops WHERE json_type(r) = 'OBJECT'
      UNION ALL
      SELECT message_id, parent_path, record_path, c AS r, k, parent_id, depth + 1 AS depth FROM (
        SELECT message_id, record_path AS parent_path, record_path || '/' || k || ':' || unnest(range(len(l))) AS record_path, unnest(l) AS c, k, parent_id, depth FROM (
          SELECT message_id, record_path, k, parent_id, depth, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] END AS l FROM (
            SELECT message_id, record_path, k, r ->> '$.id' AS parent_id, depth, json_extract(r, '$."' || k || '"') AS v FROM (
              SELECT message_id, record_path, r, depth, unnest(json_keys(json_extract(r, '$.links'))) AS k FROM records WHERE json_type(json_extract(r, '$.links')) = 'OBJECT') a
            WHERE k <> 'links' AND json_exists(r, '$."' || k || '"')) b) g WHERE l IS NOT NULL) h
      WHERE json_type(c) = 'OBJECT')
"""

_RELATION_MODELS = " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in {**wire.LINK_MODELS, "rentals_fee": "RentalsFee", "owners": "Owner", "notes": "Note", "author": "Author", "attachments": "Attachment"}.items())
_CHILD = f"CASE WHEN json_type(lv) = 'OBJECT' AND json_type(lv, '$.type') = 'VARCHAR' THEN lv ->> '$.type' ELSE CASE k {_RELATION_MODELS} END END"
_TREE = _NESTED[: _NESTED.index("events AS")] + f"""events AS (SELECT message_id, unnest(range(len(l))) AS e, unnest(l) AS x FROM lists WHERE l IS NOT NULL),
    datas AS (SELECT message_id, e, x ->> '$.model_name' AS model, json_extract(x, '$.data') AS d FROM events WHERE json_type(x) = 'OBJECT'),
    datalists AS (SELECT message_id, e, model, CASE json_type(d) WHEN 'ARRAY' THEN json_extract(d, '$[*]') WHEN 'OBJECT' THEN [d] END AS l FROM datas),
    tops AS (SELECT message_id, e, model, unnest(range(len(l))) AS p, unnest(l) AS r FROM datalists WHERE l IS NOT NULL),
    nodes AS (
      SELECT message_id, NULL::VARCHAR AS parent_path, NULL::VARCHAR AS parent_model, NULL::VARCHAR AS parent_id, e || '/' || p AS record_path, model, r FROM tops WHERE json_type(r) = 'OBJECT'
      UNION ALL
      SELECT message_id, parent_path, parent_model, parent_id, parent_path || '/' || k || ':' || n AS record_path, {_CHILD} AS model, c AS r FROM (
        SELECT message_id, parent_path, parent_model, parent_id, k, lv, unnest(range(len(l))) AS n, unnest(l) AS c FROM (
          SELECT message_id, record_path AS parent_path, model AS parent_model, r ->> '$.id' AS parent_id, k, json_extract(r, '$.links."' || k || '"') AS lv,
            CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] END AS l FROM (
            SELECT *, json_extract(r, '$."' || k || '"') AS v FROM (
              SELECT *, unnest(json_keys(json_extract(r, '$.links'))) AS k FROM nodes WHERE json_type(json_extract(r, '$.links')) = 'OBJECT') a
            WHERE k <> 'links') b) g WHERE l IS NOT NULL) h
      WHERE json_type(c) = 'OBJECT'),
    fields AS (SELECT *, r ->> '$.id' AS raw_id, r ->> '$.created_at' AS c, r ->> '$.updated_at' AS u, r ->> '$.canceled_at' AS x FROM nodes)
"""


def _of_table(model: str) -> str:
    raw = lambda name: f"(r ->> '$.links.{name}')"
    link = lambda name: f"CASE WHEN json_type(r, '$.links.{name}') NOT IN ('OBJECT', 'ARRAY') THEN {_id(raw(name))} END AS {name}_id"
    return _TREE + f"""SELECT message_id, record_path, parent_path, parent_model, {_id('parent_id')} AS parent_id, {_id('raw_id')} AS id, r ->> '$.name' AS name,
      {_us('c')} AS created_us, {_us('u')} AS updated_us, {_us('x')} AS canceled_us{''.join(', ' + link(c) for c in NODE_LINKS[model])} FROM fields WHERE model = '{model}'"""


ORACLES = {
    **{f"p3_table_{underscore(m)}": _of_table(m) for m in NODE_LINKS},
    "p2_table": f"""WITH {_CHANGES}, last_gone AS (SELECT model, id, max(t * 2 + 1) FILTER (gone) AS g FROM changes GROUP BY model, id),
      c AS (SELECT changes.*, t * 2 + gone::INT > coalesce(g, -9223372036854775808) AS after FROM changes JOIN last_gone USING (model, id))
      SELECT model AS model_name, id AS synced_id, max(t) AS version_us,
      (arg_max(synced_account_id, t * 2 + gone::INT) FILTER (synced_account_id IS NOT NULL AND after))::VARCHAR AS synced_account_id,
      (arg_max(created_us, t * 2 + gone::INT) FILTER (created_us IS NOT NULL AND after))::VARCHAR AS created_us,
      arg_max(name, t * 2 + gone::INT) FILTER (name IS NOT NULL AND after) AS name
      FROM c GROUP BY model, id HAVING NOT arg_max(gone, t * 2 + gone::INT)""",
    "p1_found": _ORPHANS + "SELECT record_no, relation, target_id FROM orphans",
    "p1_by_month": _ORPHANS + "SELECT model, strftime(received_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY 1, 2",
    "p2_found": f"WITH {_CHANGES} {_PRESENT}",
    "p2_present": f"""WITH {_CHANGES} SELECT model AS model_name, id AS synced_id, max(t) AS version_us,
      (arg_max(synced_account_id, t * 2 + gone::INT) FILTER (synced_account_id IS NOT NULL))::VARCHAR AS synced_account_id,
      (arg_max(created_us, t * 2 + gone::INT) FILTER (created_us IS NOT NULL))::VARCHAR AS created_us,
      arg_max(name, t * 2 + gone::INT) FILTER (name IS NOT NULL) AS name
      FROM changes GROUP BY model, id HAVING NOT arg_max(gone, t * 2 + gone::INT)""",
    "p4_found": f"WITH {_VERSIONS} SELECT run_no, outbox_id FROM due",
    "p4_per_run": f"WITH {_VERSIONS} SELECT run_no, count(*) AS n_rows FROM due GROUP BY run_no",
    "p5_found": f"""SELECT arrival_no FROM (SELECT arrival_no, row_number() OVER (PARTITION BY m, i, t ORDER BY arrival_no) AS n FROM (
      SELECT arrival_no, lower(trim(model_name)) AS m, {_id('synced_id')} AS i, {_us('synced_updated_at')} AS t FROM deserialized_records) k
      WHERE i IS NOT NULL AND t IS NOT NULL) d WHERE n > 1""",
    "p5_seen": f"""SELECT DISTINCT lower(trim(model_name)) || ':' || {_id('synced_id')} AS producer, {_us('synced_updated_at')} AS lo, {_us('synced_updated_at')} AS hi
      FROM deserialized_records WHERE {_id('synced_id')} IS NOT NULL AND {_us('synced_updated_at')} IS NOT NULL""",
    "p3_found": _NESTED + "SELECT message_id, parent_path, record_path FROM records WHERE parent_path IS NOT NULL",
    "p3_links": _NESTED + "SELECT message_id, record_path, k AS relation, r ->> '$.id' AS record_id, parent_id, depth FROM records WHERE parent_path IS NOT NULL",
}
