"""Row changes to created, updated and destroyed events, and their changesets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.scan import running


def with_previous(log: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "old_", block: Column | None = None) -> DataFrame:
    """Each version beside the one before it: adds old_<column> and is_first.

    With `block`, which must rise with `order`, a key with very many versions is spread over its
    blocks; then `order` must be total and its first column not null. Else a key's versions are sorted in one task.
    """
    row = F.struct(*columns)
    if block is None:
        seen = log.withColumn("__before", F.lag(row).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        marked = log.withColumn("__block", block).withColumn("__state", F.struct(*order, row.alias("row")))
        seen = running(marked, keys, "__block", order, "__state", "__before", inclusive=False).withColumn("__before", F.col("__before.row")).drop("__block", "__state")
    seen = seen.withColumn("is_first", F.col("__before").isNull())
    return seen.withColumns({prefix + c: F.col(f"__before.{c}") for c in columns}).drop("__before")


def transition(old_deleted: Column, new_deleted: Column, is_first: Column, is_last_destroy: Column | None = None, after_soft_delete: bool = False) -> Column:
    """Event of a version from its soft-delete stamp before and after, null where nothing is published.

    First version: created. Stamp cleared: created. Stamp set, or set anew: destroyed. Never stamped:
    updated. Stamped as before: updated only with `after_soft_delete`. `is_last_destroy` marks hard deletes.
    """
    kind = (
        F.when(is_first, "created")
        .when(old_deleted.isNotNull() & new_deleted.isNull(), "created")
        .when(new_deleted.isNotNull() & ~old_deleted.eqNullSafe(new_deleted), "destroyed")
        .when(new_deleted.isNull(), "updated")
    )
    if after_soft_delete:
        kind = kind.otherwise("updated")
    return kind if is_last_destroy is None else F.when(is_last_destroy, "destroyed").otherwise(kind)


def changed(columns: list[str], prefix: str = "old_") -> Column:
    """Whether any column differs from the version before, null counting as a value."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(prefix + c))
    return ~same


def changeset(columns: list[str], prefix: str = "old_") -> Column:
    """MAP of each changed attribute to STRUCT(old, new), as text."""
    entry = lambda c: F.when(
        ~F.col(c).eqNullSafe(F.col(prefix + c)),
        F.struct(F.lit(c).alias("key"), F.struct(F.col(prefix + c).cast("string").alias("old"), F.col(c).cast("string").alias("new")).alias("value")),
    )
    return F.map_from_entries(F.array_compact(F.array(*map(entry, columns))))


def destroyed_changeset(key: str, created: str) -> Column:
    """Changeset of a hard delete: key and creation time go to null."""
    pair = lambda c: F.struct(F.col(c).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    return F.create_map(F.lit(key), pair(key), F.lit(created), pair(created))


def long_changes(df: DataFrame, keys: list[str], columns: list[str], prefix: str = "old_") -> DataFrame:
    """One row per changed attribute: keys, attr, old, new as text; unchanged attributes give none."""
    entries = F.array(
        *(F.struct(F.lit(c).alias("attr"), F.col(prefix + c).cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in columns)
    )
    return df.select(*keys, F.inline(entries)).where(~F.col("old").eqNullSafe(F.col("new")))


def encrypted(changes: Column, key: Column) -> Column:
    """Changeset text under AES, in base 64."""
    return F.base64(F.aes_encrypt(changes, key))


def decrypted(cipher: Column, key: Column) -> Column:
    """Text of an encrypted changeset; "{}" where there is none, null where it can't be read."""
    return F.when(cipher.isNull(), "{}").otherwise(F.try_aes_decrypt(F.unbase64(cipher), key).cast("string"))
