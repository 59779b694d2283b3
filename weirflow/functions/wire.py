"""Reading ids, times, model names and event names as producers spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The models a consumer knows, in their canonical spelling.
MODELS = ("Rental", "Booking", "Client", "BookingsFee", "Tax", "Fee")
ACCOUNT = "Account"

# The model that each singular or plural link name refers to.
LINK_MODELS = {
    "account": "Account",
    "rental": "Rental",
    "client": "Client",
    "fee": "Fee",
    "booking": "Booking",
    "bookings": "Booking",
    "bookings_fees": "BookingsFee",
    "taxes": "Tax",
}

_BLANKS = " \t\r\n"


def text(value: Column) -> Column:
    """Text without outer blanks; empty text is null."""
    bare = F.btrim(value, F.lit(_BLANKS))
    return F.when(bare != "", bare)


def whole_number(value: Column) -> Column:
    """The whole number that a text spells ("7", " 007", "7.0", "1e2"), else null. A fraction is looked at before anything is rounded."""
    bare = F.btrim(value, F.lit(_BLANKS))
    # Casts that fail are slow, so texts are looked at first.
    whole = F.when(bare.rlike(r"^[+-]?(\d+\.?0*|\.0+)$"), bare).try_cast("decimal(38,0)").try_cast("bigint")
    powered = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), bare).try_cast("decimal(38,18)")
    return F.when(bare.rlike(r"^[+-]?\d{1,18}$"), bare.try_cast("bigint")).otherwise(F.coalesce(whole, F.when(powered == F.floor(powered), powered).try_cast("bigint")))


def epoch_us(value: Column) -> Column:
    """Epoch microseconds of a wire time.

    Bare digits are epoch milliseconds, an offset or zone is honoured, a time without one is UTC.
    Null, empty and unreadable texts give null.
    """
    bare = F.btrim(value, F.lit(_BLANKS))
    sign = lambda at: F.substring(bare, at, 1).isin("+", "-")
    offset = (F.length(bare) > 16) & (sign(-6) | sign(-5) | sign(-3))
    zoned = F.upper(F.substring(bare, -1, 1)).isin("Z", "C", "T") | offset
    clock = F.when(zoned, bare).when(F.length(bare) <= 10, F.concat(bare, F.lit(" 00:00:00Z"))).otherwise(F.concat(bare, F.lit("Z")))
    # Without this a bare clock time, or nothing, would be read as one of today.
    dated = F.when(F.substring(bare, 5, 1) == "-", clock)
    # Milliseconds of more digits lie beyond any calendar.
    return F.when(bare.rlike(r"^\d{1,14}$"), bare.try_cast("bigint") * 1000).otherwise(F.unix_micros(dated.try_cast("timestamp")))


def us_of(timestamp: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp that means UTC, whatever the session's zone."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), timestamp.cast("timestamp_ntz"))
    return F.unix_micros(local.cast("timestamp"))


def model_key(name: Column) -> Column:
    """Form in which equal model names are equal: lower case, no outer blanks."""
    return F.lower(text(name))


def model_name(name: Column, known: tuple[str, ...] = (*MODELS, ACCOUNT)) -> Column:
    """Canonical model name, null for a model that nobody knows."""
    return F.create_map(*(F.lit(x) for m in known for x in (m.lower(), m)))[model_key(name)]


def event_kind(event: Column) -> Column:
    """created, updated or destroyed by the ending of the event's name, else null."""
    return F.coalesce(*(F.when(event.endswith(k), F.lit(k)) for k in ("created", "updated", "destroyed")))
