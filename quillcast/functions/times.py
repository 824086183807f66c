"""Time expressions. Times without a zone are ``timestamp_ntz`` throughout."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillcast import fixed
from quillcast.functions.text import as_col

_TIME_OF_DAY = r"^\d{1,2}:\d{2}$"
# Date formats of feeds once the name of the day is gone.
_MAIL_DATES = (
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss xx",
    "d MMM yyyy HH:mm z",
    "d MMM yyyy HH:mm xx",
    "d MMM yyyy H:mm:ss z",
    "d MMM yyyy H:mm:ss xx",
    "d MMM yy H:mm:ss z",
    "d MMM yy H:mm:ss xx",
)


# Zone names of mail dates, which mean one offset all year.
_MAIL_ZONES = {
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def at(t: datetime) -> Column:
    """A point in time in UTC, whatever the zone of the session; without a zone it is UTC."""
    if t.tzinfo:
        t = t.astimezone(timezone.utc)
    return F.lit(f"{t:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz")


def instant(c: Column | str) -> Column:
    """The instant of a UTC time, which event times of streams must be."""
    return F.concat(as_col(c).cast("string"), F.lit("Z")).cast("timestamp")


def utc(c: Column | str) -> Column:
    """UTC time of an instant, whatever the zone of the session."""
    seconds = F.unix_micros(as_col(c)).cast("decimal(20,0)") / F.lit(1_000_000)
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def utc_date(c: Column | str) -> Column:
    """Date in UTC of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(as_col(c)) / 86400).cast("int"))


def published_at(c: Column | str) -> Column:
    """UTC time of a feed date (mail or ISO style), null where it is neither."""
    text = F.regexp_replace(F.trim(as_col(c)), r"^[A-Za-z]+,\s*", "")
    for name, offset in _MAIL_ZONES.items():
        text = F.regexp_replace(text, f" {name}$", f" {offset}")
    mail = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in _MAIL_DATES))
    zoned = F.when(text.rlike(r"([Zz]|[+-]\d{2}(:?\d{2})?)$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), zoned.try_cast("timestamp"))
    # from the instant itself: a local time is told twice when clocks go back
    return utc(F.coalesce(mail, iso))


def long_date(c: Column | str) -> Column:
    """``Friday, May 9 2025``."""
    return F.date_format(as_col(c), "EEEE, MMMM d yyyy")


def is_time_of_day(c: Column | str) -> Column:
    """True for ``H:MM`` or ``HH:MM`` within a day."""
    hour, minute = hour_of(c), minute_of(c)
    return F.coalesce(
        as_col(c).rlike(_TIME_OF_DAY) & hour.between(0, 23) & minute.between(0, 59), F.lit(False)
    )


def hour_of(c: Column | str) -> Column:
    return F.get(F.split(as_col(c), ":"), F.lit(0)).try_cast("int")


def minute_of(c: Column | str) -> Column:
    return F.get(F.split(as_col(c), ":"), F.lit(1)).try_cast("int")


def local_time(c: Column | str, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(c).cast("timestamp_ntz"))


def day_start(c: Column | str, zone: str = "UTC") -> Column:
    """UTC time of the last midnight in ``zone``."""
    midnight = F.to_date(local_time(c, zone)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), midnight)


def digest_day(
    c: Column | str, at: str = fixed.DIGEST_TIME, zone: str = fixed.DIGEST_ZONE
) -> Column:
    """Date of the first daily run at or after a UTC time."""
    hour, minute = (int(part) for part in at.split(":"))
    offset = F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(0.000001))
    return F.date_add(F.to_date(local_time(c, zone) - offset), 1)
