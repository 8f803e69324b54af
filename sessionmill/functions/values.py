"""Lenient casts and path/time helpers.

All of them are plain Catalyst expressions.  None depends on the session time
zone: epoch milliseconds are turned into dates by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_PER_DAY = 86_400_000


def to_long(text: Column) -> Column:
    """Whole number from text; halves round away from zero ('2.5' is 3, '-2.5' is -3) and '1e3' is 1000."""
    rounded = F.round(text.try_cast("double")).try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), rounded)


def to_count(text: Column) -> Column:
    return F.coalesce(to_long(text), F.lit(0).cast("bigint"))


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def is_true(text: Column) -> Column:
    """Truth of a boolean given as text; anything unreadable is false."""
    return F.coalesce(text.try_cast("boolean"), F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def ntz_millis(stamp: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, read as UTC; half a millisecond rounds up."""
    minutes = (F.hour(stamp) * 60 + F.minute(stamp)).cast("bigint")
    within = F.floor(F.extract(F.lit("SECOND"), stamp) * 1000 + F.lit(0.5).cast("decimal(2,1)"))
    return F.unix_date(F.to_date(stamp)).cast("bigint") * MILLIS_PER_DAY + minutes * 60_000 + within.cast("bigint")


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 text; NULL if it is none.

    A zone suffix is dropped, not applied, so '...+02:00' and '...Z' give the
    same instant for the same wall clock. A text without year, month and day is no time.
    """
    dated = F.when(text.rlike(r"^\s*[+-]?\d+-\d{1,2}-\d{1,2}"), text)
    return ntz_millis(dated.try_cast("timestamp_ntz"))


def utc_date(millis: Column) -> Column:
    return F.date_from_unix_date(F.floor(millis / MILLIS_PER_DAY).cast("int"))


def zone_date(millis: Column, zone: str = "UTC") -> Column:
    """Calendar date of an instant in a named zone."""
    if zone == "UTC":
        return utc_date(millis)
    return F.to_date(_wall_clock(millis, zone))


def zone_text(millis: Column, zone: str = "UTC") -> Column:
    """Instant as 'yyyy-MM-ddTHH:mm:ss.ffffff' wall clock text of a zone."""
    return F.date_format(_wall_clock(millis, zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _wall_clock(millis: Column, zone: str) -> Column:
    day = F.make_dt_interval(days=F.floor(millis / MILLIS_PER_DAY).cast("int"))
    seconds = (F.pmod(millis, F.lit(MILLIS_PER_DAY)) / F.lit(1000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + day + F.make_dt_interval(secs=seconds)
    if zone == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def last_part(path: Column) -> Column:
    """Text after the last '/', the whole text if there is none."""
    return F.substring_index(path, "/", -1)


def part_from_end(path: Column, n: int) -> Column:
    """n-th '/'-separated part counted from the end; NULL if there are fewer."""
    enough = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) >= n - 1
    return F.when(enough, F.substring_index(F.substring_index(path, "/", -n), "/", 1))


def has_key(document: Column, key: str) -> Column:
    """Whether a JSON object has the key at all, a null value included."""
    return F.array_contains(F.json_object_keys(document), key)


def json_text(document: Column, key: str) -> Column:
    """Value of a key: a string as it is, anything else as JSON text, null as 'null'."""
    return F.coalesce(F.get_json_object(document, f"$.{key}"), F.when(has_key(document, key), "null"))
