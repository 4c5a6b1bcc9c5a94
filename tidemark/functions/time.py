"""Column functions on times. All zones are parameters; naive times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_key(ts: Column, by: str) -> Column:
    """Key of an hour, day, month or week. A week has the CALENDAR year and the ISO week: 2024-12-30 is 2024-W01."""
    formats = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    if by == "week":
        return F.concat(F.year(ts), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, formats[by])


def iso_week_key(ts: Column) -> Column:
    """Key of an ISO week in its ISO year: 2024-12-30 is 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def time_of_day(ts: Column, zone: str = "UTC") -> Column:
    """night, morning, afternoon, evening: six hours each, in a zone."""
    hour = F.hour(F.from_utc_timestamp(ts.cast("timestamp"), zone))
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def parse_utc(text: Column) -> Column:
    """ISO text as a time; Z and offsets are heeded, none means UTC. Null if it can't be read: a query has no now."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))


def parse_flexible(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "dd/MM/yyyy")) -> Column:
    """By the first format that reads it, else as ISO text."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats), parse_utc(text))


def display(ts: Column, style: str = "default", zone: str = "UTC") -> Column:
    styles = {"default": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd", "time": "HH:mm", "short": "dd.MM.yyyy HH:mm"}
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), styles[style])


def in_night(ts: Column, start_minute: int = 0, end_minute: int = 540, zone: str = "Europe/Moscow") -> Column:
    """Whether the local time is in [start, end) minutes of the day."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return (F.hour(local) * 60 + F.minute(local) >= start_minute) & (F.hour(local) * 60 + F.minute(local) < end_minute)


def age_days(ts: Column, as_of: Column) -> Column:
    """Age in days, with fractions."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000


def time_decay(ts: Column, as_of: Column, invert: bool = False) -> Column:
    """1 / (1 + whole days of age), 1 for null: newer rows have larger values; with `invert`, 1 minus that."""
    value = F.coalesce(1 / (1 + F.floor(age_days(ts, as_of))), F.lit(1.0))
    return 1 - value if invert else value


def half_life_decay(weight: Column, elapsed: Column, half_life: float) -> Column:
    return weight * F.pow(F.lit(0.5), elapsed / half_life)
