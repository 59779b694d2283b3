"""Problem 2: the present table from a feed of inserts, updates and deletes.

Per-key ordered replay: rows are brought together by key, sorted by sequence, and a state machine
applies each row's non-null columns. The same fold first runs inside every input partition, before
the shuffle, so a key with a third of all rows reaches its final task as one state per input
partition. States merge in any order because each column remembers the sequence that set it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.functions.binding import select_where

_NEVER = np.iinfo(np.int64).min


def _merge(states: pa.Table, keys: list[str], columns: list[str]) -> pa.Table:
    """One state per run of equal keys."""
    n = states.num_rows
    fresh = np.zeros(n, bool)
    fresh[0] = True
    for k in keys:
        col = states[k].combine_chunks()
        differs = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), True)
        fresh[1:] |= differs.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, n))
    out = {k: states[k].take(pa.array(starts)) for k in keys}
    for c in ("seq", "gone_seq"):
        top = np.maximum.reduceat(pc.fill_null(states[c], _NEVER).to_numpy(), starts)
        out[c] = pa.array(top, mask=top == _NEVER)
    for c in columns:
        seq = pc.fill_null(states[f"{c}__seq"], _NEVER).to_numpy()
        top = np.maximum.reduceat(seq, starts)
        at = np.where(seq == np.repeat(top, lengths), np.arange(n), -1)
        at = np.maximum.reduceat(at, starts)
        out[c] = states[c].take(pa.array(at, mask=top == _NEVER))
        out[f"{c}__seq"] = pa.array(top, mask=top == _NEVER)
    return pa.table(out).select(states.column_names)


def _folder(keys: list[str], columns: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held.cast(rows.schema), rows])
            done = _merge(rows, keys, columns)
            held = done.slice(done.num_rows - 1)
            yield from done.slice(0, done.num_rows - 1).cast(rows.schema).to_batches()
        if held is not None:
            yield from held.to_batches()

    return fold


def as_states(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Changes (keys, seq, gone, columns) in the form of states: each column with the sequence that set it."""
    return changes.where(F.col("seq").isNotNull()).select(
        *keys,
        "seq",
        F.when(F.col("gone"), F.col("seq")).alias("gone_seq"),
        *(x for c in columns for x in (F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")).alias(f"{c}__seq"))),
    )


def replay(changes: DataFrame, keys: list[str], columns: list[str], state: DataFrame | None = None) -> DataFrame:
    """State of every key after all changes: keys, seq, gone_seq, and each column with `<column>__seq`.

    `changes` has the keys, seq BIGINT, gone BOOLEAN and the columns; a null column changes nothing.
    Rows without a sequence are left out; keys must not be null. A sequence that was already applied
    (in these changes, or in `state`, an earlier result) changes nothing when it comes again. Of
    different rows with one key and sequence the column value met last in the sort stands.
    """
    fold = _folder(keys, columns)
    states = as_states(changes, keys, columns)
    local = states.sortWithinPartitions(*keys, "seq").mapInArrow(fold, states.schema)
    if state is not None:
        local = local.unionByName(state)
    # 64-bit hash of the keys keeps one key together and the partition count with the session.
    return local.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(fold, states.schema)


def present(states: DataFrame, keys: list[str], columns: list[str], clear: bool = True) -> DataFrame:
    """Records that stand: the latest sequence is no removal. With `clear`, values set before the last removal are gone."""
    kept = F.coalesce(F.col("gone_seq"), F.lit(_NEVER))
    value = lambda c: F.when(F.col(f"{c}__seq") > kept, F.col(c)).alias(c) if clear else F.col(c)
    return states.where(F.col("gone_seq").isNull() | (F.col("gone_seq") < F.col("seq"))).select(*keys, "seq", *map(value, columns))


def feed_changes(feed: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The consumer's feed as changes: model_name, synced_id, seq (time in microseconds, doubled, plus one for a removal), gone, columns.

    Events count by the ending of their name. Rows without id, time or known model, and other
    events, change nothing and are left out. `only` names the columns wanted; model_name, synced_id
    and seq must be among them.
    """
    time = F.coalesce(wire.epoch_us(F.col("synced_updated_at")), wire.epoch_us(F.col("synced_created_at")))
    kind = wire.event_kind(F.col("event"))
    gone = (kind == "destroyed") | wire.text(F.col("synced_canceled_at")).isNotNull()
    columns = {
        "model_name": wire.model_name(F.col("model_name"), wire.MODELS),
        "synced_id": wire.whole_number(F.col("synced_id")),
        "seq": time * 2 + gone.cast("bigint"),
        "gone": gone,
        "synced_account_id": F.col("synced_account_id").cast("bigint"),
        "created_us": wire.epoch_us(F.col("synced_created_at")),
        "name": wire.text(F.col("name")),
    }
    known = lambda r: r["model_name"].isNotNull() & r["synced_id"].isNotNull() & r["seq"].isNotNull()
    return select_where(feed.where(kind.isNotNull()), {c: columns[c] for c in only or columns}, known)
