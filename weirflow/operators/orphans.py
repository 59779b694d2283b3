"""Problem 1: references to records that do not exist.

Parent changes and child references are united in one tagged long form, grouped by parent table and
key, and a reference is kept when no parent stands at its moment. Keys are cut into blocks of time
(see scan.running), so a key that a third of all references name is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.functions.binding import let, select_where
from weirflow.operators.scan import running
from weirflow.sources.tables import stored

WEEK_US = 7 * 86_400_000_000


def references(records: DataFrame, links: str = "links") -> DataFrame:
    """One row per reference under `links`: record_no, received_us, relation, model, target_id; distinct within a record.

    `links` that is null, cut off or not one whole JSON object holds none. Nulls, empty values and
    texts that are no whole number refer to nothing. An object with `type` and `id` refers to the
    model in `type`, whatever its key; other keys count only if wire.LINK_MODELS names them.
    """
    # A second element after the text shows whether the text was exactly one value.
    parts = F.from_json(
        F.concat(F.lit("["), F.col(links), F.lit(',{"end":"1"}]')),
        "array<map<string,string>>",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    whole = let(parts, lambda p: F.when((F.size(p) == 2) & (p[1]["end"] == "1"), p[0]))
    # explode_outer: plain explode adds a filter on its input, which would parse everything again.
    pairs = records.select("record_no", wire.us_of(F.col("received_at")).alias("received_us"), F.explode_outer(whole).alias("relation", "value"))
    named = F.create_map(*(F.lit(x) for pair in wire.LINK_MODELS.items() for x in pair))[F.col("relation")]
    some = lambda model, ids: F.struct(model.alias("model"), F.array_distinct(F.transform(ids, wire.whole_number)).alias("ids"))

    def read(v: Column) -> Column:
        of_object = let(F.from_json(v, "struct<type:string,id:string>"), lambda t: some(F.coalesce(wire.model_name(t["type"]), wire.text(t["type"])), F.array(t["id"])))
        many = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
        return F.when(v.startswith("{"), of_object).when(named.isNotNull(), some(named, many))

    found = pairs.select("record_no", "received_us", "relation", let(wire.text(F.col("value")), read).alias("found"))
    ids = F.explode_outer(F.when(F.col("found.model").isNotNull(), F.col("found.ids")))
    return found.select("record_no", "received_us", "relation", F.col("found.model").alias("model"), ids.alias("target_id")).where("target_id is not null")


def feed_changes(feed: DataFrame) -> DataFrame:
    """Changes of the consumer's feed: model, target_id, received_us, state.

    `state` orders as the change's time, a removal after anything else of the same instant; it is
    even when the record stands after the change and odd when it is gone.
    """
    time = F.coalesce(wire.epoch_us(F.col("synced_updated_at")), wire.epoch_us(F.col("synced_created_at")))
    kind = wire.event_kind(F.col("event"))
    gone = (kind == "destroyed") | wire.text(F.col("synced_canceled_at")).isNotNull()
    columns = {
        "model": wire.model_name(F.col("model_name"), wire.MODELS),
        "target_id": wire.whole_number(F.col("synced_id")),
        "received_us": wire.us_of(F.col("received_at")),
        "state": time * 2 + gone.cast("bigint"),
    }
    every = lambda r: r["model"].isNotNull() & r["target_id"].isNotNull() & r["received_us"].isNotNull() & r["state"].isNotNull()
    return select_where(feed.where(kind.isNotNull()), columns, every)


def account_changes(accounts: DataFrame) -> DataFrame:
    """Accounts in the form of feed_changes: standing from creation until just before cancellation."""
    made, ended = wire.us_of(F.col("synced_created_at")), wire.us_of(F.col("synced_canceled_at"))
    spans = accounts.where(F.col("synced_id").isNotNull() & made.isNotNull() & (ended.isNull() | (ended > made)))
    edges = F.array(
        F.struct(made.alias("received_us"), (made * 2).alias("state")),
        F.struct(ended.alias("received_us"), (ended * 2 + 1).alias("state")),
    )
    return spans.select(F.lit(wire.ACCOUNT).alias("model"), F.col("synced_id").cast("bigint").alias("target_id"), F.inline(edges)).where(
        "received_us is not null"
    )


def orphans(children: DataFrame, parents: DataFrame, block_us: int = WEEK_US) -> DataFrame:
    """References of `children` (see references) whose target doesn't stand in `parents` (see feed_changes) at received_us.

    A change received at the very moment of the reference counts. A reference without received_us
    or target counts as orphaned. Repeated rows give repeated results; an empty side is fine.
    """
    block = F.floor(F.col("received_us") / block_us)
    long = (
        parents.withColumn("tag", F.lit(0))
        .unionByName(children.withColumn("tag", F.lit(1)), allowMissingColumns=True)
        .withColumn("block", block)
    )
    # Both passes of the scan below would parse the texts again.
    seen = running(stored(long, "references"), ["model", "target_id"], "block", ["received_us", "tag"], "state", "latest")
    return seen.where((F.col("tag") == 1) & (F.coalesce(F.pmod("latest", F.lit(2)), F.lit(1)) == 1))


def by_period(found: DataFrame) -> DataFrame:
    """Number of orphaned references per referenced model and month of received_at."""
    moment = F.timestamp_micros("received_us").cast("timestamp_ntz")  # in the session's zone
    month = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment), "yyyy-MM")
    return found.groupBy("model", month.alias("month")).agg(F.count("*").alias("orphans"))
