"""Names of events, topics and keys, and the inflections that tie link names to models."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# Endings of plurals and what stands in their place, the first that fits counts; group 1 is kept. Used as they are here and in column form.
SINGULARS = (
    (r"((?:^|_)(?:series|species|news|equipment|information))$", ""),
    (r"((?:^|_)p)eople$", "erson"),
    (r"((?:^|_)child)ren$", ""),
    (r"((?:^|_)(?:wo)?m)en$", "an"),
    (r"((?:^|_)(?:movie|cookie|tie|pie))s$", ""),
    (r"((?:^|_)(?:bus|status|alias|virus|campus|bonus|census|gas))es$", ""),
    (r"((?:analy|cri|diagno|hypothe|synop)s)es$", "is"),
    (r"((?:^|_)(?:kni|li|wi))ves$", "fe"),
    (r"((?:^|_)(?:cal|hal|shel|wol|lea|thie|loa))ves$", "f"),
    (r"(.)ies$", "y"),
    (r"(x|ss|ch|sh|zz)es$", ""),
    (r"(ss|us|is)$", ""),
    (r"(.)s$", ""),
)
_PLURALS = (
    (r"((?:^|_)(?:series|species|news|equipment|information))$", ""),
    (r"((?:^|_)p)erson$", "eople"),
    (r"((?:^|_)child)$", "ren"),
    (r"((?:^|_)(?:wo)?m)an$", "en"),
    (r"((?:analy|cri|diagno|hypothe|synop)s)is$", "es"),
    (r"((?:^|_)(?:kni|li|wi))fe$", "ves"),
    (r"((?:^|_)(?:cal|hal|shel|wol|lea|thie|loa))f$", "ves"),
    (r"([^aeiou])y$", "ies"),
    (r"(x|ss|ch|sh|zz)$", "es"),
    (r"(s)$", ""),
    (r"(.)$", "s"),
)


def _inflected(name: str, rules: tuple[tuple[str, str], ...]) -> str:
    for ending, instead in rules:
        if re.search(ending, name):
            return re.sub(ending, rf"\g<1>{instead}", name)
    return name


@functools.lru_cache(4096)
def singular(name: str) -> str:
    """Singular of a relation name ("taxes", "categories", "statuses", "movies", "series"); a name without a plural's ending is its own."""
    return _inflected(name, SINGULARS)


def plural(name: str) -> str:
    """Plural of a relation name; one that ends in s already counts as plural."""
    return _inflected(name, _PLURALS)


@functools.lru_cache(4096)
def classify(name: str) -> str:
    """Model name of a singular relation name: "bookings_fee" gives "BookingsFee"."""
    return "".join(part[:1].upper() + part[1:] for part in name.split("_"))


def underscore(model: str) -> str:
    """Resource name of a model: "BookingsFee" gives "bookings_fee"."""
    return "".join(("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(model))


def event_name(resource: Column | str, kind: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(as_column(resource), F.lit("_"), as_column(kind))


def topic_name(namespace: str, name: str, replica: bool = False) -> str:
    return f"{namespace}_{name}" + ("_genesis" if replica else "")


def message_key(model: Column | str, key: Column) -> Column:
    return F.concat(F.lit(model) if isinstance(model, str) else model, F.lit(":"), key.cast("string"))


def partition_key(value: Column) -> Column:
    """Partition key of an attribute: its whole number as text, "0" where it is null or unreadable."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0)).cast("string")
