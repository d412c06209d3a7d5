"""Civil time: zones, buckets and calendar fields on zone-less timestamps that hold UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Africa/Kigali"
WIDTHS = {"15 minutes": 900, "1 hour": 3600, "3 hours": 10_800, "6 hours": 21_600, "1 day": 86_400, "7 days": 604_800}


def local(ts: Column, zone: str = ZONE) -> Column:
    """UTC wall time to the zone's wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def bucket(ts: Column, width: str, origin: str = "2000-01-01 00:00:00") -> Column:
    """Start of the bucket of ``width`` that holds ``ts``; buckets are counted from ``origin``."""
    seconds = WIDTHS[width]
    start = ntz(origin)
    past = F.timestamp_diff("MICROSECOND", start, ts)
    whole = F.floor((past - F.pmod(past, F.lit(seconds * 1_000_000))) / 1_000_000)
    return F.timestamp_add("SECOND", whole, start)


def local_bucket(ts: Column, width: str, zone: str = ZONE, origin: str = "2000-01-01 00:00:00") -> Column:
    """The bucket in the zone's wall time, given back as UTC."""
    return utc(bucket(local(ts, zone), width, origin), zone)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def slot_of_day(ts: Column, minutes: int = 15) -> Column:
    """Minute of the day at which the slot of ``minutes`` that holds ``ts`` starts."""
    past = F.hour(ts) * 60 + F.minute(ts)
    return (past - past % minutes).cast("int")


def iso_with_offset(ts: Column, zone: str = ZONE) -> Column:
    """UTC wall time as ISO-8601 text in a zone, with microseconds and the zone's offset."""
    there = local(ts, zone)
    minutes = F.timestamp_diff("MINUTE", ts, there)
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60))
    return F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)


def utc_of_iso(text: Column) -> Column:
    """ISO-8601 text as UTC wall time; text without an offset is UTC, and other text null."""
    sign = F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1)
    shift = sign * (F.substring(text, -5, 2).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int"))
    bare = F.substring(text, F.lit(1), F.length(text) - 6).try_cast("timestamp_ntz")
    plain = F.regexp_replace(text, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "").try_cast("timestamp_ntz")
    return F.when(text.rlike(r"T.*[+-][0-9]{2}:[0-9]{2}$"), F.timestamp_add("MINUTE", -shift, bare)).otherwise(plain)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def snapped(start: str, end: str, zone: str = ZONE) -> tuple[Column, Column]:
    """A range widened to whole local days, as UTC; an end at local midnight adds no day."""
    low = utc(F.date_trunc("day", local(ntz(start), zone)).cast("timestamp_ntz"), zone)
    last = local(ntz(end) - F.expr("interval 1 microsecond"), zone)
    high = utc(F.date_trunc("day", last).cast("timestamp_ntz") + F.expr("interval 1 day"), zone)
    return low, high


def within(ts: Column, start, end) -> Column:
    """start <= ts < end; strings are UTC wall times."""
    low = ntz(start) if isinstance(start, str) else start
    high = ntz(end) if isinstance(end, str) else end
    return (ts >= low) & (ts < high)


def trailing_number(name: Column) -> Column:
    """The number in a name like 'Region 10', null where there is none."""
    return F.regexp_extract(name, "[0-9]+", 0).try_cast("int")
