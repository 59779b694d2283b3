"""Problem 3: flat tables out of deeply nested records.

Every record of a message gets interval labels by depth-first traversal: `pre` when it is entered,
`post` when it is left. A record lies inside another exactly when its interval does, so parents are
found from the labels alone, by one sorted pass per message and level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.functions.jsontext import decoded, encoded
from weirflow.functions.naming import classify, singular

NODES = (
    "message_id bigint, pre int, post int, depth int, record_path string, relation string, event string, model_name string,"
    " record_id string, links string, attributes string"
)
_FIELDS = [f.split() for f in NODES.split(",")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])


def _list(value) -> list:
    return value if isinstance(value, list) else [value]


def _child_model(relation: str, links: dict) -> str:
    link = links.get(relation)
    if isinstance(link, dict) and isinstance(link.get("type"), str):
        return link["type"]
    return classify(singular(relation))


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else encoded(value)


def walk(message_id: int, value: str | None, payload: bool) -> list[tuple]:
    """The nodes of one message, in order of entry."""
    if value is None:
        return []
    try:
        envelope = decoded(value)
        if isinstance(envelope, str):
            envelope = decoded(envelope)
    except ValueError:
        return []
    if not isinstance(envelope, dict) or envelope.get("message") is None:
        return []
    nodes: list[list] = []
    clock = 0
    stack: list[tuple] = []
    for e, event in enumerate(_list(envelope["message"])):
        if not isinstance(event, dict):
            continue
        tops = [(r, f"{e}/{i}") for i, r in enumerate(_list(event.get("data"))) if isinstance(r, dict)]
        name, model = _text(event.get("event")), _text(event.get("model_name"))
        stack += [(r, path, 0, None, name, model) for r, path in reversed(tops)]
        while stack:
            record, path, depth, relation, name, model = stack.pop()
            if record is None:  # leave the node whose number stands in path
                nodes[path][2] = clock
                clock += 1
                continue
            links = record.get("links")
            links = links if isinstance(links, dict) else {}
            inner = []
            for key, child in record.items():
                if key == "links" or key not in links:
                    continue
                if isinstance(child, dict):
                    inner.append((child, f"{path}/{key}:0", depth + 1, key, name, _child_model(key, links)))
                elif isinstance(child, list):
                    inner += [
                        (c, f"{path}/{key}:{i}", depth + 1, key, name, _child_model(key, links))
                        for i, c in enumerate(child)
                        if isinstance(c, dict)
                    ]
            if payload:
                nested = {key for *_, key, _, _ in inner}
                plain = {k: v for k, v in record.items() if k not in nested and k not in ("links", "id")}
                extra = [_text(record.get("id")), encoded(links), encoded(plain)]
            else:
                extra = [None, None, None]
            stack.append((None, len(nodes), 0, None, None, None))
            nodes.append([message_id, clock, 0, depth, path, relation, name, model, *extra])
            clock += 1
            stack += reversed(inner)
    return nodes


MOST_NODES = 8192  # handed on at once


def _batch(found: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _SCHEMA)], schema=_SCHEMA)


def label(messages: DataFrame, payload: bool = True) -> DataFrame:
    """Nodes (see NODES) of every message_value: one row per record, with its interval and path.

    A top record's path is `<event position>/<record position>`; a record nested under a key that
    is also a key of its parent's `links` has the parent's path plus `/<key>:<position>`. Null
    messages, invalid JSON and envelopes without `message` give no row, nor do other objects and
    what lies in them. Messages delivered again give their rows again. Records and attributes may be
    nested to any depth. Without `payload` ids, links and attributes are left null.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = []
            for m, v in zip(batch["message_id"].to_pylist(), batch["message_value"].to_pylist()):
                found += walk(m, v, payload)
                while len(found) >= MOST_NODES:
                    yield _batch(found[:MOST_NODES])
                    del found[:MOST_NODES]
            if found:
                yield _batch(found)

    return messages.select("message_id", "message_value").mapInArrow(nodes, NODES)


def link(nodes: DataFrame) -> DataFrame:
    """Nested nodes with `parent_path`, `parent_model` and `parent_id`, found by interval containment.

    Within one message and level, the parent of a node is the node one level up that was entered
    last before it and is not yet left; one sorted pass finds it, however many siblings there are.
    """
    up = F.struct("pre", "post", F.col("record_path").alias("path"), F.col("model_name").alias("model"), F.col("record_id").alias("id"))
    doors = nodes.withColumn("level", F.col("depth")).withColumn("parent", up).withColumn("child", F.lit(False))
    inside = nodes.where("depth > 0").withColumn("level", F.col("depth") - 1).withColumn("parent", F.lit(None).cast(doors.schema["parent"].dataType)).withColumn("child", F.lit(True))
    order = Window.partitionBy("message_id", "level").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    return (
        doors.unionByName(inside)
        .withColumn("parent", F.last("parent", ignorenulls=True).over(order))
        .where(F.col("child") & (F.col("parent.pre") < F.col("pre")) & (F.col("post") < F.col("parent.post")))
        .withColumn("parent_path", F.col("parent.path"))
        .withColumn("parent_model", F.col("parent.model"))
        .withColumn("parent_id", F.col("parent.id"))
        .drop("parent", "child", "level")
    )


TIMES = ("created_at", "updated_at", "canceled_at")


def node_table(nodes: DataFrame, model: str, attributes: dict[str, str] | None = None, links: tuple[str, ...] = ()) -> DataFrame:
    """The flat table of one model out of all nodes (with payload), tied to the tables of its parents.

    message_id and record_path name a row; parent_path, parent_model and parent_id the record that it lies in, by
    interval containment, null for top records. Then id, the attributes (name: type; text, or null where the
    type doesn't fit), the times in epoch microseconds, and the ids that the named links to one record have.
    Names that neither record nor link has give null.
    """
    own = nodes.where(F.col("model_name") == model)
    # Top records have no parent; nested ones are linked among all nodes, as their parents are of any model.
    linked = link(nodes).where(F.col("model_name") == model)
    every = own.where("depth = 0").unionByName(linked, allowMissingColumns=True)
    of = lambda source, name: F.get_json_object(source, f"$['{name}']")
    plain = [of("attributes", c).try_cast(t).alias(c) for c, t in (attributes or {"name": "string"}).items()]
    times = [wire.epoch_us(of("attributes", c)).alias(c.removesuffix("_at") + "_us") for c in TIMES]
    ids = [wire.whole_number(of("links", c)).alias(f"{c}_id") for c in links]
    return every.select(
        "message_id", "record_path", "parent_path", "parent_model", wire.whole_number(F.col("parent_id")).alias("parent_id"), wire.whole_number(F.col("record_id")).alias("id"), *plain, *times, *ids
    )
