"""Messages out of records: attributes, links, embedded relations, envelope and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import naming
from weirflow.plans.spec import ModelSpec, Topic


def attributes(df: DataFrame, spec: ModelSpec) -> list[Column]:
    """Primary key as `id` and the declared attributes, computed ones by their expression."""
    value = lambda a: spec.computed[a](df) if a in spec.computed else F.col(a)
    return [F.col(spec.primary_key).alias("id"), *(value(a).alias(a) for a in spec.attributes if a != "id")]


def aggregate(
    roots: DataFrame, spec: ModelSpec, children: dict[str, tuple[DataFrame, ModelSpec]], embed: Sequence[str] = ()
) -> DataFrame:
    """Snapshot of every root: `key` and `record`, a struct of attributes, `links` and the embedded relations, one level deep.

    A to-one link is the foreign key; a to-many link the sorted ids of the children, empty where there
    are none. Children are summed up by foreign key before they meet the roots, so a root is never
    multiplied; roots without children stay. `children` gives table and spec of each relation.
    """
    base = roots.select(F.col(spec.primary_key).alias("key"), F.struct(*attributes(roots, spec)).alias("own"), *(F.col(r.key).alias(f"fk_{r.name}") for r in spec.relations if not r.many))
    links, embedded = [], []
    for r in spec.relations:
        table, child = children.get(r.name, (None, None))
        wanted = r.name in embed
        if r.many:
            if table is None:
                continue
            one = F.struct(*attributes(table, child))
            gathered = table.where(F.col(r.key).isNotNull()).groupBy(F.col(r.key).alias("key")).agg(
                F.array_sort(F.collect_list(F.col(child.primary_key))).alias(f"ids_{r.name}"),
                *([F.array_sort(F.collect_list(one)).alias(f"all_{r.name}")] if wanted else []),
            )
            base = base.join(gathered, "key", "left")
            links.append(F.coalesce(f"ids_{r.name}", F.array().cast(gathered.schema[f"ids_{r.name}"].dataType)).alias(r.name))
            if wanted:
                embedded.append(F.coalesce(f"all_{r.name}", F.array().cast(gathered.schema[f"all_{r.name}"].dataType)).alias(r.name))
        else:
            links.append(F.col(f"fk_{r.name}").alias(r.name))
            if wanted and table is not None:
                one = table.select(F.col(child.primary_key).alias(f"fk_{r.name}"), F.struct(*attributes(table, child)).alias(f"one_{r.name}"))
                base = base.join(one, f"fk_{r.name}", "left")
                embedded.append(F.col(f"one_{r.name}").alias(r.name))
    link = F.struct(*links) if links else F.create_map().cast("map<string,string>")
    return base.select("key", F.struct("own.*", link.alias("links"), *embedded).alias("record"))


def raw(rows: DataFrame, key: str = "id") -> DataFrame:
    """Messages without serializer: the whole row as JSON, for topics that don't serialize."""
    return rows.select(F.col(key).alias("key"), to_json(F.struct(*rows.columns)).alias("record"))


def deleted(key: Column) -> Column:
    """JSON of a record that is gone: its id and empty links."""
    return F.concat(F.lit('{"id":'), F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(',"links":{}}'))


def current(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Outbox rows beside the record as it is now: adds `record` and `exists` from snapshots (resource_class, resource_id, record).

    Created and updated rows of records that are gone are left out; destroyed rows stay.
    """
    seen = rows.join(snapshots.withColumn("exists", F.lit(True)), ["resource_class", "resource_id"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    return seen.where(F.col("exists") | F.col("event_name").endswith("destroyed"))


def vanished(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The rows that `current` leaves out."""
    return rows.where(~F.col("event_name").endswith("destroyed")).join(snapshots, ["resource_class", "resource_id"], "left_anti")


def envelope(event: Column, model: Column, record_json: Column) -> Column:
    """Message text of one record: {"message":[{"event","model_name","data":[record]}]}. A null record gives null."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit('{"message":[{"event":'), quoted(event), F.lit(',"model_name":'), quoted(model), F.lit(',"data":['), record_json, F.lit("]}]}"))


def to_json(record: Column) -> Column:
    """JSON that keeps null fields, as consumers tell null from absent."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def publishable(groups: DataFrame, items: str = "records") -> DataFrame:
    """Publications none of whose events has an empty record list; one empty list abandons the whole publication."""
    return groups.where(F.size("events") > 0).where(F.forall("events", lambda e: F.size(e[items]) > 0))


def partition_key(df: DataFrame, topic: Topic, default: str | Callable[[DataFrame], Column] | None = "account_id") -> Column:
    """Partition key of a topic: its own rule, else the default; null where the model lacks the attribute."""
    rule = topic.partition_key if topic.partition_key is not None else default
    if callable(rule):
        return rule(df).cast("string")
    return naming.partition_key(F.col(rule)) if rule in df.columns else F.lit(None).cast("string")


def routed(messages: DataFrame, topic: Topic, genesis_only: bool = False, partitions: int = 12) -> DataFrame:
    """Messages (key, partition_key, value) with topic and partition; with a replica, each once more under the replica's name.

    `genesis_only` keeps the replica alone. Equal partition keys share a partition.
    """
    names = ([] if genesis_only else [topic.full_name]) + ([topic.replica_name] if topic.genesis_replica else [])
    route = F.coalesce("partition_key", "key")
    return messages.withColumn("topic", F.explode(F.array(*map(F.lit, names)))).withColumn("partition", F.pmod(F.hash(route), F.lit(partitions)))


def tombstones(keys: DataFrame) -> DataFrame:
    """Null messages under their keys."""
    return keys.withColumn("value", F.lit(None).cast("string"))


def record_text(rows: DataFrame, snapshots: DataFrame, topic: Topic, key: str = "id") -> DataFrame:
    """What a topic's messages hold: key and record (JSON). Snapshots (key, record as struct), or the rows as they are for a topic that doesn't serialize."""
    return snapshots.select("key", to_json(F.col("record")).alias("record")) if topic.serialize else raw(rows, key)


def is_tombstone(value: Column) -> Column:
    """Null, or the JSON text null."""
    return value.isNull() | (F.btrim(value, F.lit(" \t\r\n")) == "null")
