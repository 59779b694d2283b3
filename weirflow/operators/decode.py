"""Messages to canonical records, with VARIANT keeping null apart from absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import naming
from weirflow.functions.binding import let

# Keys of a record that are no plain attributes.
RESERVED = ("links", "id", "created_at", "updated_at", "canceled_at")


def _listed(value: Column) -> Column:
    """An array as it is, anything else but null as the only element of one."""
    return let(value, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))))


def _shape(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("scalar")


def envelope(value: Column) -> Column:
    """The message envelope as VARIANT; one that is a quoted JSON text counts as what it quotes. Null where there is none."""
    quoted = F.ltrim(value).startswith('"')
    return F.try_parse_json(F.when(quoted, F.try_variant_get(F.try_parse_json(value), "$", "string")).otherwise(value))


def events(messages: DataFrame, value: str = "message_value") -> DataFrame:
    """One row per event: the other columns, event_no, event, model_name and records (ARRAY<VARIANT>).

    Tombstones, unreadable texts and envelopes without `message` give none; `data` that is one object is an array of one.
    """
    others = [c for c in messages.columns if c != value]
    # The outer form: plain posexplode adds a filter on its input, which would parse every message again.
    listed = messages.select(*others, F.posexplode_outer(_listed(F.try_variant_get(envelope(F.col(value)), "$.message", "variant"))).alias("event_no", "e")).where("event_no is not null")
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    return listed.select(
        *others, "event_no", get("$.event", "string").alias("event"), get("$.model_name", "string").alias("model_name"), _listed(get("$.data", "variant")).alias("records")
    )


def records(found: DataFrame) -> DataFrame:
    """One row per top record of the events: record_no and record."""
    return found.select(*(c for c in found.columns if c != "records"), F.posexplode_outer("records").alias("record_no", "record")).where("record_no is not null")


def unreadable(messages: DataFrame, value: str = "message_value") -> DataFrame:
    """Messages with a value from which no event can be read, for a table of rejects; tombstones are none."""
    parsed = F.try_parse_json(F.col(value))
    tombstone = F.col(value).isNull() | F.coalesce(F.is_variant_null(parsed), F.lit(False))
    return messages.where(~tombstone & F.try_variant_get(envelope(F.col(value)), "$.message", "variant").isNull())


def singular(name: Column) -> Column:
    """Column form of naming.singular, by the same rules."""
    return F.coalesce(*(F.when(name.rlike(ending), F.regexp_replace(name, ending, f"$1{instead}")) for ending, instead in naming.SINGULARS), name)


def canonical(found: DataFrame, record: str = "record") -> DataFrame:
    """Adds attributes (MAP<STRING,VARIANT>), has_many and has_one to rows with a record.

    A link gives synced_<name>_id, for an object also synced_<name>_type, for an array
    synced_<singular>_ids. The id becomes synced_id; the three times become synced_* only where their key
    is present. Plain attributes win over names made from links. Relations are the links' keys: to many
    where the link is an array, and named by the link's type where that is given; a relation that isn't
    embedded has null records.
    """
    entries = "array<struct<key:string,value:variant>>"
    null = F.lit(None).cast("variant")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    get = lambda v, path: F.try_variant_get(v, path, "variant")

    def of_link(e: Column) -> Column:
        name, value = e["key"], e["value"]
        prefix = F.concat(F.lit("synced_"), name)
        return (
            F.when(e["shape"] == "object", F.array(entry(F.concat(prefix, F.lit("_id")), get(value, "$.id")), entry(F.concat(prefix, F.lit("_type")), get(value, "$.type"))))
            .when(e["shape"] == "array", F.array(entry(F.concat(F.lit("synced_"), singular(name), F.lit("_ids")), value)))
            .otherwise(F.array(entry(F.concat(prefix, F.lit("_id")), value)))
        )

    def stamps(r: Column) -> Column:
        own = [F.array(entry(F.lit("synced_id"), F.coalesce(r["id"], null)))]
        for c in ("created_at", "updated_at", "canceled_at"):
            own.append(F.when(F.map_contains_key(r, F.lit(c)), F.array(entry(F.lit(f"synced_{c}"), r[c]))).otherwise(F.array().cast(entries)))
        return F.map_from_entries(F.flatten(F.array(*own)))

    def named(r: Column, links: Column) -> Column:
        """The last writer of a name wins: links (of two that make one name the later), then stamps, then plain attributes."""
        plain = F.map_filter(r, lambda k, _: ~k.isin(*RESERVED) & ~F.exists(links, lambda e: e["key"] == k))
        return let(
            F.struct(plain.alias("p"), stamps(r).alias("s"), F.flatten(F.transform(links, of_link)).alias("k")),
            lambda x: F.map_concat(
                F.map_from_entries(
                    F.filter(
                        x["k"],
                        lambda e, i: ~F.map_contains_key(x["p"], e["key"])
                        & ~F.map_contains_key(x["s"], e["key"])
                        & ~F.exists(F.slice(x["k"], i + 2, F.size(x["k"])), lambda later: later["key"] == e["key"]),
                    )
                ),
                F.map_filter(x["s"], lambda k, _: ~F.map_contains_key(x["p"], k)),
                x["p"],
            ),
        )

    def many(r: Column, links: Column) -> Column:
        own = F.filter(links, lambda e: e["shape"] == "array")
        return F.transform(own, lambda e: F.struct(e["key"].alias("name"), e["key"].alias("relation"), _listed(r[e["key"]]).alias("records")))

    def one(r: Column, links: Column) -> Column:
        own = F.filter(links, lambda e: e["shape"] != "array")
        kind = lambda e: F.when(e["shape"] == "object", F.try_variant_get(e["value"], "$.type", "string"))
        return F.transform(
            own,
            lambda e: F.struct(F.coalesce(kind(e), e["key"]).alias("name"), e["key"].alias("relation"), F.try_element_at(_listed(r[e["key"]]), F.lit(1)).alias("record")),
        )

    def links_of(r: Column) -> Column:
        held = F.coalesce(F.map_entries(F.try_variant_get(r["links"], "$", "map<string,variant>")), F.array().cast(entries))
        return F.transform(held, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), _shape(e["value"]).alias("shape")))

    whole = let(
        F.try_variant_get(record, "$", "map<string,variant>"),
        lambda r: let(links_of(r), lambda links: F.struct(named(r, links).alias("attributes"), many(r, links).alias("has_many"), one(r, links).alias("has_one"))),
    )
    return found.withColumn("__c", whole).withColumns({c: F.col(f"__c.{c}") for c in ("attributes", "has_many", "has_one")}).drop("__c")


def children(parents: DataFrame, keep: list[str]) -> DataFrame:
    """Embedded records one level below canonical rows: keep, relation name, position, record, to_many. Relations that aren't embedded give none."""
    many = parents.select(*keep, F.inline("has_many").alias("name", "relation", "records")).where(F.col("records").isNotNull())
    many = many.select(*keep, "name", F.lit(True).alias("to_many"), F.posexplode("records").alias("position", "record"))
    one = parents.select(*keep, F.inline("has_one").alias("name", "relation", "record")).where(F.col("record").isNotNull())
    one = one.select(*keep, "name", F.lit(False).alias("to_many"), F.lit(0).alias("position"), "record")
    return many.unionByName(one).where(F.try_variant_get("record", "$", "map<string,variant>").isNotNull())
