"""Date choice, proximity, decay and bucketing rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# Fixed values of the scoring rules.
RECENCY_DECAY_DAYS = 365
MIN_RANGE_DAYS = 0.01
LINK_WINDOW_HOURS = 24
LINK_WEIGHT_FLOOR = 0.3
STALE_AFTER_DAYS = 7
EVENT_BUCKET_HOURS = 12


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def midpoint(start: Column, end: Column) -> Column:
    half = F.floor((micros(end) - micros(start)) / 2).cast("bigint")
    return F.timestamp_micros(micros(start) + half)


def best_date(occurred_start: Column, occurred_end: Column, mentioned_at: Column, event_date: Column) -> Column:
    """Middle of a closed interval, else the first known of the four dates."""
    middle = F.when(occurred_start.isNotNull() & occurred_end.isNotNull(), midpoint(occurred_start, occurred_end))
    return F.coalesce(middle, occurred_start, occurred_end, mentioned_at, event_date)


def best_event_time(event_date: Column, occurred_start: Column, mentioned_at: Column) -> Column:
    """The date temporal links use; note the order differs from best_date."""
    return F.coalesce(event_date, occurred_start, mentioned_at)


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_US))


def temporal_proximity(best: Column, start: Column, end: Column) -> Column:
    """1 in the middle of [start, end], falling linearly to 0 at its ends."""
    total = F.greatest(days_between(end, start), F.lit(MIN_RANGE_DAYS))
    distance = F.abs(days_between(best, midpoint(start, end)))
    return F.greatest(F.lit(0.0), 1.0 - distance / (total / 2.0))


def recency(created_at: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0.0), days_between(as_of, created_at))
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - age / RECENCY_DECAY_DAYS), F.lit(0.0))


def link_weight(a: Column, b: Column) -> Column:
    hours = F.abs(micros(a) - micros(b)) / F.lit(float(HOUR_US))
    return F.greatest(F.lit(LINK_WEIGHT_FLOOR), 1.0 - hours / LINK_WINDOW_HOURS)


def event_bucket(event_date: Column, hours: int = EVENT_BUCKET_HOURS) -> Column:
    """Start of the half-open ``hours``-long UTC bucket that holds the date."""
    width = hours * HOUR_US
    return F.timestamp_micros(F.floor(micros(event_date) / width).cast("bigint") * F.lit(width))


def is_stale(last_refreshed_at: Column, as_of: Column) -> Column:
    whole_days = F.floor(days_between(as_of, last_refreshed_at))
    return F.coalesce(whole_days >= STALE_AFTER_DAYS, F.lit(True))


def time_period(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when((hour >= 5) & (hour < 11), "morning").when((hour >= 11) & (hour < 17), "afternoon").otherwise("evening")
    )


def format_ts(iso: Column) -> Column:
    """ISO text as ``[YYYY/MM/DD HH:mm]`` nine hours east of UTC."""
    local = F.try_to_timestamp(iso) + F.expr("interval 9 hours")
    return F.coalesce(F.date_format(local, "'['yyyy/MM/dd HH:mm']'"), F.lit("[不明]"))
