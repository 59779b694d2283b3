"""Received events to local tables: duplicates, filters, last-writer-wins gate, deletes, merge and change feed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weirflow.functions import naming, wire
from weirflow.functions.jsontext import decoded, encoded
from weirflow.operators import decode
from weirflow.operators.scan import running
from weirflow.plans.spec import ModelSpec
from weirflow.sources.tables import spread, stored

# --- duplicates within a batch -------------------------------------------------------------------


def dedupe_latest(rows: DataFrame, keys: list[str], time: str, arrival: str) -> DataFrame:
    """The latest row of every key, with `first_arrival`, the place of its group in the order of arrival.

    A row without time counts as just now, so it beats every time, and the last such row wins; of equal
    times the earliest arrival wins. An aggregate with partial sums, so hot keys collapse before the shuffle.
    """
    missing = F.col(time).isNull()
    rank = F.struct(missing.alias("now"), F.col(time).alias("at"), F.when(missing, F.col(arrival)).otherwise(-F.col(arrival)).alias("n"))
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("__row"), F.min(arrival).alias("first_arrival"))
    return found.select(*keys, "__row.*", "first_arrival")


def dedupe_applies(messages: DataFrame, batch: list[str], value: str = "message_value") -> DataFrame:
    """Per batch whether duplicates may be removed: every message has one event, and that one record."""
    events = decode._listed(F.try_variant_get(decode.envelope(F.col(value)), "$.message", "variant"))
    single = (F.size(events) == 1) & F.coalesce(F.size(decode._listed(F.try_variant_get(F.get(events, 0), "$.data", "variant"))) == 1, F.lit(False))
    return messages.groupBy(*batch).agg(F.count("*").alias("n_messages"), F.bool_and(F.coalesce(single, F.lit(False))).alias("applies"))


def deduplicated(messages: DataFrame, batch: list[str], order: list[str], value: str = "message_value") -> DataFrame:
    """Messages without repeated ones, in batches where that may be done (see dedupe_applies); all others as they are.

    Of the messages of one event and id in a batch the latest stays (see dedupe_latest), by the record's
    updated_at; it takes the place of the first (`first_arrival`, by the last of `order`). Messages without id are
    never copies of each other. `order` must be total, its last column a whole number.
    """
    arrival = order[-1]
    e = F.try_variant_get(decode.envelope(F.col(value)), "$.message", "variant")
    first = F.get(decode._listed(e), 0)
    record = F.get(decode._listed(F.try_variant_get(first, "$.data", "variant")), 0)
    get = lambda v, path: F.try_variant_get(v, path, "string")
    told = messages.withColumns({"__event": get(first, "$.event"), "__model": wire.model_key(get(first, "$.model_name")), "__id": wire.whole_number(get(record, "$.id")), "__time": wire.epoch_us(get(record, "$.updated_at"))})
    told = told.join(dedupe_applies(messages, batch, value).where("applies").select(*batch, F.lit(True).alias("__applies")), batch, "left")
    once = F.col("__applies") & F.col("__id").isNotNull()
    others = told.where(~F.coalesce(once, F.lit(False))).select(*messages.columns, F.col(arrival).alias("first_arrival"))
    latest = dedupe_latest(told.where(once), [*batch, "__event", "__model", "__id"], "__time", arrival)
    return others.unionByName(latest.select(*messages.columns, "first_arrival"))


# --- filters -------------------------------------------------------------------------------------


def ignored_by(filters: list[tuple[str, Column]]) -> Column:
    """Name of the first filter that ignores the event, null if none does. A null condition doesn't ignore."""
    if not filters:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in filters))


def split(rows: DataFrame, filters: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, ignored with `ignored_by`)."""
    marked = rows.withColumn("ignored_by", ignored_by(filters))
    return marked.where("ignored_by is null").drop("ignored_by"), marked.where("ignored_by is not null")


# --- last writer wins ----------------------------------------------------------------------------


def gate(
    rows: DataFrame, keys: list[str], created: str, updated: str, arrival: str, block: int = 1 << 16, stored: DataFrame | None = None
) -> DataFrame:
    """Adds `accepted`: whether a row is applied when rows come in order of arrival.

    It is unless its time (updated, else created) lies before the latest updated time applied so
    far; a missing time on either side lets it through. Rejected rows lie below the maximum, so the
    maximum over all earlier rows decides. `stored` (keys, updated) holds what the target has. For
    models with an updated column that are never hard-deleted; else use `consume`.
    """
    marked = rows.withColumn("__block", F.floor(F.col(arrival) / block))
    if stored is not None:
        start = stored.select(*keys, F.col(updated).alias(updated), F.lit(None).cast("long").alias("__block"))
        start = start.withColumn("__block", F.lit(-(1 << 62)))
        marked = marked.unionByName(start.withColumn("__stored", F.lit(True)), allowMissingColumns=True)
    seen = running(marked, keys, "__block", [arrival], updated, "stored_time", inclusive=False)
    time = F.coalesce(updated, created)
    out = seen.withColumn("accepted", F.coalesce(time >= F.col("stored_time"), F.lit(True)))
    if stored is not None:
        out = out.where("__stored is null").drop("__stored")
    return out.drop("__block")


def latest_state(gated: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The row that stands for every key: the last one accepted."""
    others = [c for c in gated.columns if c not in keys]
    return gated.where("accepted").groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(arrival)).alias("__row")).select(*keys, "__row.*")


# --- deletes -------------------------------------------------------------------------------------


def delete_decision(kind: Column, root: Column, soft: Column, has_column: Column, has_key: Column) -> Column:
    """What an accepted event does: cancel, assign, destroy, restore or none.

    `soft`: the model has the soft-delete action; `has_column`: it has the soft-deleted-at column;
    `has_key`: the payload carries the deletion time.
    """
    return (
        F.when(
            kind == "destroyed",
            F.when(~root, "assign").when(has_column & has_key, "assign").when(soft, "cancel").otherwise("destroy"),
        )
        .when(kind.isin("created", "updated"), F.when(has_column & ~has_key, "restore").when(has_column, "assign").otherwise("none"))
        .otherwise("none")
    )


def restorable(spec: ModelSpec, has_key: Column) -> Column:
    return F.lit(spec.deleted_column is not None) & ~has_key


# --- bulk writes and children --------------------------------------------------------------------


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], gate_column: str | None = None) -> DataFrame:
    """The target with the incoming rows (one per key) in place of its own; with a gate column, unless the target's is later."""
    others = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*others).alias("__old"))
    n = incoming.select(*keys, F.struct(*others).alias("__new"))
    take = F.col("__new").isNotNull()
    if gate_column:
        take = take & F.coalesce(F.col(f"__new.{gate_column}") >= F.col(f"__old.{gate_column}"), F.lit(True))
    return t.join(n, keys, "full_outer").withColumn("__row", F.when(take, F.col("__new")).otherwise(F.col("__old"))).select(*keys, "__row.*")


def bulk_destroy(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys), keys, "left_anti")


def prune_children(local: DataFrame, payload: DataFrame, parent: str, child: str) -> DataFrame:
    """Local children of the parents in the payload that it no longer lists.

    `payload` has one row per parent: its id and the list of child ids; a null list means that the
    relation wasn't embedded and nothing is pruned, an empty list prunes all.
    """
    told = payload.where(F.col("ids").isNotNull())
    listed = told.select(parent, F.explode("ids").alias(child))
    return local.join(told.select(parent).distinct(), parent, "left_semi").join(listed, [parent, child], "left_anti")


def backfill(table: DataFrame, columns: dict[str, str], data: str = "synced_data") -> DataFrame:
    """Columns (name: type) taken from the retained payload; a key that it lacks makes the column null."""
    value = F.try_parse_json(F.col(data)) if dict(table.dtypes)[data] == "string" else F.col(data)
    return table.withColumns({c: F.try_variant_get(value, f"$.{c}", t) for c, t in columns.items()})


def mapped(spec: ModelSpec, columns: list[str]) -> dict[str, str]:
    """Remote attribute: local column, by the model's mapping, for those that the model has."""
    local = {remote: own for own, remote in spec.mapping.items()}
    return {c: local.get(c, c) for c in columns if not spec.attributes or local.get(c, c) in spec.attributes}


def local_table(rows: DataFrame, spec: ModelSpec, types: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a model's local table out of rows with synced_id, created_us, updated_us, canceled_us and synced_data (JSON of the canonical attributes).

    Remote attributes go to local columns by the model's mapping; those that the model doesn't declare are dropped. The
    times go to the columns that the model has for them, if it has them. `types` gives column types, text
    by default; a value that doesn't fit is null. `keep` names columns that stay.
    """
    data = F.try_parse_json("synced_data")
    local = [F.try_variant_get(data, f"$['{spec.mapping.get(c, c)}']", (types or {}).get(c, "string")).alias(c) for c in spec.attributes]
    times = [(spec.created_column, "created_us"), (spec.updated_column, "updated_us"), (spec.deleted_column, "canceled_us")]
    return rows.select(*keep, "synced_id", *local, *(F.col(us).alias(c) for c, us in times if c))


def resolve_to_one(rows: DataFrame, link: str, target: DataFrame, key: str, out: str, local: str | None = None) -> DataFrame:
    """Adds `out`: the local key of the target row that the link names, null where there is none. `target` has `key` once per row."""
    found = target.select(F.col(key).alias("__key"), F.col(local or key).alias(out))
    return rows.join(found, rows[link] == F.col("__key"), "left").drop("__key")


# --- the whole consumer --------------------------------------------------------------------------

STATE = "model string, synced_id bigint, created_us bigint, updated_us bigint, canceled_us bigint, synced_data string"
FEED = "place string, model string, synced_id bigint, event string, root boolean, accepted boolean, action string, changes string"
_STATE = [f.split()[0] for f in STATE.split(",")]
_IN = "model string, synced_id bigint, place string, event string, kind string, root boolean, has_created boolean, has_updated boolean, has_canceled boolean, created_us bigint, updated_us bigint, canceled_us bigint, received_us bigint, data string"


def _diff(old: dict, new: dict) -> dict:
    return {k: [old.get(k), new.get(k)] for k in sorted({*old, *new}) if old.get(k) != new.get(k)}


def _folder(specs: dict[str, ModelSpec], out_schema: pa.Schema):
    """State machine over rows sorted by model, synced_id and order; a key's stored state has the empty place and comes first."""

    def step(spec: ModelSpec, state: dict | None, row: dict) -> tuple[dict | None, tuple]:
        time = row["updated_us"] if row["updated_us"] is not None else row["created_us"]
        held = None if state is None else state["updated_us" if spec.updated_column else "created_us"]
        about = (row["place"], row["model"], row["synced_id"], row["event"], row["root"])
        data = json.loads(row["data"])
        if spec.bulk and row["root"] and row["kind"] in ("created", "destroyed"):
            if row["kind"] == "destroyed":
                return None, (*about, True, "bulk_destroy", "{}")
            return {c: row[c] for c in ("created_us", "updated_us", "canceled_us")} | {"data": data}, (*about, True, "bulk_import", "{}")
        if held is not None and time is not None and time < held:
            return state, (*about, False, "stale", "{}")
        old = state or {"created_us": None, "updated_us": None, "canceled_us": None, "data": {}}
        new = dict(old, data=data)
        for c in ("created", "updated", "canceled"):
            if row[f"has_{c}"]:
                new[f"{c}_us"] = row[f"{c}_us"]
        has_column, has_key = spec.deleted_column is not None, row["has_canceled"]
        if not has_column:
            new["canceled_us"] = old["canceled_us"]
        action = "none"
        if row["kind"] == "destroyed":
            if not row["root"] or (has_column and has_key):
                action = "assign"
            elif spec.soft_delete:
                action = "cancel"
                new["canceled_us"] = time if time is not None else row["received_us"]
            else:
                return None, (*about, True, "destroy", json.dumps(_diff(old["data"], data), ensure_ascii=False))
        elif has_column:
            action = "assign" if has_key else "restore"
            if not has_key:
                new["canceled_us"] = None
        return new, (*about, True, action, json.dumps(_diff(old["data"], data), ensure_ascii=False))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, state, spec = None, None, None

        def final() -> dict | None:
            if key is None or state is None:
                return None
            return dict(zip(_STATE, (*key, state["created_us"], state["updated_us"], state["canceled_us"], json.dumps(state["data"], ensure_ascii=False))))

        def emit(states: list[dict], feed: list[tuple]) -> Iterator[pa.RecordBatch]:
            if states or feed:
                rows = [{"state": s, "feed": None} for s in states] + [{"state": None, "feed": dict(zip((f.split()[0] for f in FEED.split(",")), f))} for f in feed]
                yield from pa.Table.from_pylist(rows, out_schema).to_batches()

        for batch in batches:
            states, feed = [], []
            for row in batch.to_pylist():
                here = (row["model"], row["synced_id"])
                if here != key:
                    if (s := final()) is not None:
                        states.append(s)
                    key, state, spec = here, None, specs[row["model"]]
                if row["place"] == "":
                    state = {c: row[c] for c in ("created_us", "updated_us", "canceled_us")} | {"data": json.loads(row["data"] or "{}")}
                else:
                    state, told = step(spec, state, row)
                    feed.append(told)
            yield from emit(states, feed)
        if (s := final()) is not None:
            yield from emit([s], [])

    return fold


def _arrow(ddl: str) -> pa.DataType:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.struct([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(","))])


def _fold(rows: DataFrame, specs: dict[str, ModelSpec]) -> DataFrame:
    schema = pa.schema([("state", _arrow(STATE)), ("feed", _arrow(FEED))])
    as_struct = lambda ddl: "struct<" + ",".join(f"{n}:{t}" for n, t in (f.split() for f in ddl.split(","))) + ">"
    columns = [f.split()[0] for f in _IN.split(",")]
    # A stored state has no order and comes before all else.
    sorted_rows = rows.select(*columns, "order").repartition("model", "synced_id").sortWithinPartitions("model", "synced_id", "order")
    return sorted_rows.select(columns).mapInArrow(_folder(specs, schema), f"state {as_struct(STATE)}, feed {as_struct(FEED)}")


def _rows(canonical: DataFrame) -> DataFrame:
    """Canonical records in the form that the fold takes, with has_many and has_one beside it."""
    text = lambda k: F.try_variant_get(F.col("attributes")[k], "$", "string")
    has = lambda k: F.map_contains_key("attributes", F.lit(k))
    return canonical.select(
        "model",
        wire.whole_number(text("synced_id")).alias("synced_id"),
        "place",
        "order",
        "parent",
        "event",
        wire.event_kind(F.col("event")).alias("kind"),
        "root",
        has("synced_created_at").alias("has_created"),
        has("synced_updated_at").alias("has_updated"),
        has("synced_canceled_at").alias("has_canceled"),
        wire.epoch_us(text("synced_created_at")).alias("created_us"),
        wire.epoch_us(text("synced_updated_at")).alias("updated_us"),
        wire.epoch_us(text("synced_canceled_at")).alias("canceled_us"),
        "received_us",
        F.to_json("attributes", {"ignoreNullFields": "false"}).alias("data"),
        "has_many",
        "has_one",
    )


_NUMBER = "\ue000weirflow number "  # before numbers with fraction or exponent while a record passes Python, so that they come out as they went in
_QUOTED = re.compile(json.dumps(_NUMBER, ensure_ascii=False)[:-1] + r'([^"]*)"')
_STEP = StructType([StructField("many", IntegerType()), StructField("name", StringType()), StructField("position", IntegerType())])
_OWN = [("place", StringType()), ("parent", StringType()), ("path", ArrayType(_STEP)), ("model", StringType()), ("record", StringType())]


def _embedded(record: dict) -> Iterator[tuple[bool, str, int, dict]]:
    """Records that lie in a record: (to many, name, position, record). A link's array makes a relation to many, another link one to one, named by its type if it has one."""
    links = record.get("links")
    for key, value in links.items() if isinstance(links, dict) else ():
        inner = record.get(key)
        many = isinstance(value, list)
        name = key
        if isinstance(value, dict) and value.get("type") is not None and not isinstance(value["type"], (dict, list)):
            name = value["type"] if isinstance(value["type"], str) else encoded(value["type"])
        inner = inner if isinstance(inner, list) else [] if inner is None else [inner]
        for i, r in enumerate(inner if many else inner[:1]):
            if isinstance(r, dict):
                yield many, name, i, r


def walked(tops: DataFrame, known: dict[str, str]) -> DataFrame:
    """All records of top records (place, model and the columns that go on to embedded ones; record as VARIANT), one pass over any depth.

    Each record comes without those that lie in it, with its model, place, the place of the record that it lies in (parent, null for a
    top one) and the path from the top one. Records of models that aren't `known` (by lower case) are left out with all that lies in them, and so is what lies in a record without id.
    """
    carried = [c for c in tops.columns if c not in ("record", "place", "model")]
    names = [n for n, _ in _OWN]
    types = [pa.string(), pa.string(), to_arrow_type(_OWN[2][1]), pa.string(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = lambda text: int(text) if len(text) < 19 else _NUMBER + text
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []

            def batched() -> pa.RecordBatch:
                carry = batch.select(carried).take(pa.array(at, pa.int64()))
                columns = zip(*rows) if rows else [[] for _ in names]
                return pa.RecordBatch.from_arrays([*carry.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*carried, *names])

            for i, (place, model, text) in enumerate(zip(*(batch[c].to_pylist() for c in ("place", "model", "record")))):
                top = decoded(text, number, lambda t: _NUMBER + t)
                left: list[tuple] = [(top, place, None, [], model)] if isinstance(top, dict) else []
                while left:
                    record, place, parent, path, model = left.pop()
                    links = record.get("links") if isinstance(record.get("links"), dict) else {}
                    own = {k: v for k, v in record.items() if k in decode.RESERVED or k not in links}
                    rows.append((place, parent, path, model, _QUOTED.sub(r"\1", encoded(own))))
                    at.append(i)
                    if record.get("id") is None and record.get("synced_id") is None:
                        continue
                    for many, name, position, inner in _embedded(record):
                        of = known.get(naming.singular(name).replace("_", "").lower())
                        if of is not None:
                            step = {"many": 0 if many else 1, "name": name, "position": position}
                            shown = name.replace("~", "~0").replace("/", "~1")
                            left.append((inner, f"{place}/{step['many']}/{shown}/{position:012}", place, [*path, step], of))
                if len(rows) >= MOST_RECORDS:
                    yield batched()
                    rows.clear()
                    at.clear()
            yield batched()

    schema = StructType([*(tops.schema[c] for c in carried), *(StructField(n, t) for n, t in _OWN)])
    return tops.withColumn("record", F.to_json("record")).select(*carried, "place", "model", "record").mapInArrow(walk, schema)


MOST_RECORDS = 8192  # handed on at once


def _part(value: Column, number: bool) -> Column:
    """A part of a place as text: different values give different texts, also where parts are joined by "/". Numbers are padded for the eye only."""
    if number:
        digits = F.coalesce(value.cast("string"), F.lit("~"))
        return F.lpad(digits, F.greatest(F.lit(12), F.length(digits)), F.lit("0"))
    return F.coalesce(F.replace(F.replace(value.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.lit("~"))


def _place(messages: DataFrame, order: list[str]) -> Column:
    """Name of a message's place in the order, different for different places. The order itself comes from the columns, not from this text."""
    numbers = {c for c, t in messages.dtypes if t in ("tinyint", "smallint", "int", "bigint") or t.startswith("decimal")}
    return F.concat_ws("/", *(_part(F.col(c), c in numbers) for c in order))


_PATH = "array<struct<many:int,name:string,position:int>>"


def consume(
    messages: DataFrame, order: list[str], models: list[ModelSpec], target: DataFrame | None = None, filters: list[tuple[str, Column]] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, feed, rejects) of messages applied in `order` to the target (see STATE).

    `order` names columns of any types that can be ordered; messages that tie in it are taken in any order.

    Events of models that aren't listed are dropped. An embedded record counts only if the record that
    it lies in was accepted; then it passes the gate of its own key. Models may embed each other in
    cycles: whether a record counts depends on earlier records alone, so all are folded at once, those
    in rejected ones are taken out, and the keys that lose or gain rows by it are folded again until none does. Records without id,
    ignored events and unreadable messages are rejects (reason, place, detail). The feed has a row per
    record that was looked at, with action and changed attributes; the state also holds the target's rows
    that nothing touched. Null messages change nothing; repeated ones are applied again; an empty table
    leaves the target as it is.
    """
    specs = {m.name: m for m in models}
    # Reading a message takes long for its size.
    messages = spread(messages).withColumns({"__at": _place(messages, order), "__order": F.struct(*order)})
    bad = decode.unreadable(messages).select(F.lit("unreadable").alias("reason"), F.col("__at").alias("place"), F.col("message_value").alias("detail"))
    events = decode.events(messages).withColumn("model", wire.model_name(F.col("model_name"), tuple(specs)))
    events = events.where(F.col("model").isNotNull() & wire.event_kind(F.col("event")).isNotNull())
    kept, ignored = split(events, filters or [])
    bad = bad.unionByName(ignored.select(F.concat(F.lit("ignored by "), "ignored_by").alias("reason"), _place_of("__at", "event_no").alias("place"), F.col("event").alias("detail")))
    tops = decode.records(kept).withColumn("place", _place_of("__at", "event_no", "record_no")).withColumn("root", F.lit(True))
    tops = tops.withColumn("received_us", wire.us_of(F.col("received_at"))).withColumn("parent", F.lit(None).cast("string"))
    tops = tops.withColumn("order", F.struct(F.col("__order").alias("at"), "event_no", "record_no", F.array().cast(_PATH).alias("path")))
    # Stored as parts of the envelope, which is parsed once.
    every = walked(tops.select("place", "model", "event", "received_us", "order", "record"), {m.lower(): m for m in specs})
    every = every.withColumns({"order": F.col("order").withField("path", F.col("path")), "root": F.col("parent").isNull(), "record": F.try_parse_json("record")})
    rows = stored(_rows(decode.canonical(every)).drop("has_many", "has_one"), "records")
    start = None
    if target is not None:
        start = target.select("model", "synced_id", F.lit("").alias("place"), "created_us", "updated_us", "canceled_us", F.col("synced_data").alias("data"))
    every_row = rows.where("synced_id is not null")
    if start is not None:
        every_row = every_row.unionByName(start, allowMissingColumns=True)
    key = ["model", "synced_id"]
    parents = stored(rows.where("parent is not null").select("parent").distinct(), "parents")
    passed, keys, done = parents, None, None
    while True:
        # A key is folded by itself, so only those with rows that came or went are folded again.
        present = every_row if keys is None else every_row.join(keys, key, "left_semi").select(every_row.columns)
        apart = present.where("parent is null").unionByName(present.join(passed, "parent", "left_semi").select(present.columns))
        again = _fold(apart, specs).select(F.coalesce("state.model", "feed.model").alias("model"), F.coalesce("state.synced_id", "feed.synced_id").alias("synced_id"), "state", "feed")
        done = stored(again if keys is None else done.join(keys, key, "left_anti").unionByName(again), "applied")
        feed = done.where("feed is not null").select("feed.*")
        now = feed.where("accepted and action not in ('bulk_import', 'bulk_destroy')").select(F.col("place").alias("parent"))
        now = stored(now.join(parents, "parent", "left_semi"), "parents")
        turned = now.join(passed, "parent", "left_anti").unionByName(passed.join(now, "parent", "left_anti"))
        keys = stored(rows.join(turned, "parent", "left_semi").select(*key).distinct(), "turned")
        passed = now
        if keys.where("synced_id is not null").isEmpty():
            break
    present = rows.where("parent is null").unionByName(rows.join(passed, "parent", "left_semi").select(rows.columns))
    bad = bad.unionByName(present.where("synced_id is null").select(F.lit("no id").alias("reason"), "place", F.col("data").alias("detail")))
    return done.where("state is not null").select("state.*"), feed, bad


def _place_of(first: str, *rest: str) -> Column:
    return F.concat_ws("/", F.col(first), *(_part(F.col(c), True) for c in rest))


def local_changes(feed: DataFrame) -> DataFrame:
    """Changed attributes of the accepted rows in long form: place, model, synced_id, attr, old, new (as text)."""
    each = F.from_json("changes", "map<string,array<string>>")
    return feed.where("accepted").select("place", "model", "synced_id", F.explode(each).alias("attr", "pair")).select(
        "place", "model", "synced_id", "attr", F.col("pair")[0].alias("old"), F.col("pair")[1].alias("new")
    )


def root_events(feed: DataFrame, order: list[str]) -> DataFrame:
    """One row per applied root record: root_place, event, model, synced_id, action and local_changes, an array of (model, synced_id, attr, old, new).

    The changes of records that lie in it are its own too; they came with one message, so in one row.
    """
    root = F.substring_index("place", "/", len(order) + 2).alias("root_place")
    changes = local_changes(feed).groupBy(root).agg(F.array_sort(F.collect_list(F.struct("model", "synced_id", "attr", "old", "new"))).alias("local_changes"))
    told = feed.where("root and accepted").select(F.col("place").alias("root_place"), "event", "model", "synced_id", "action")
    none = F.array().cast(changes.schema["local_changes"].dataType)
    return told.join(changes, "root_place", "left").withColumn("local_changes", F.coalesce("local_changes", none))


def batch_event(feed: DataFrame) -> DataFrame:
    """One row for the whole batch, also if nothing came: how many root events it reports, and how many of them were applied.

    The events themselves stay rows of the feed; gathering them into one value would put a batch into one task.
    """
    return feed.where("root").agg(F.count("*").alias("n_events"), F.count(F.when(F.col("accepted"), 1)).alias("n_applied"))
