"""Time columns, ranges and intervals. Every stored time is UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Histogram widths, narrowest first, in seconds.
HISTOGRAM_WIDTHS = {
    "1s": 1,
    "5s": 5,
    "10s": 10,
    "30s": 30,
    "1m": 60,
    "5m": 300,
    "10m": 600,
    "30m": 1_800,
    "1h": 3_600,
    "3h": 10_800,
    "12h": 43_200,
    "1d": 86_400,
    "7d": 604_800,
    "30d": 2_592_000,
    "365d": 31_536_000,
}
MAX_BUCKETS = 60

# The quick ranges offered to users.
QUICK_RANGES = {
    "Last 15 minutes": ("now-15m", "now"),
    "Last 30 minutes": ("now-30m", "now"),
    "Last 1 hour": ("now-1h", "now"),
    "Last 4 hours": ("now-4h", "now"),
    "Last 24 hours": ("now-24h", "now"),
    "Last 7 days": ("now-7d", "now"),
    "Last 30 days": ("now-30d", "now"),
    "Last 90 days": ("now-90d", "now"),
}

_UNIT = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_RELATIVE = re.compile(r"now(?:-(\d+)([smhdw]))?")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


# -- driver-side bounds ----------------------------------------------------


def instant(value: str | datetime) -> datetime:
    """A point in time as an aware UTC datetime; a bare date is its midnight."""
    parsed = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip())
    return parsed.replace(tzinfo=timezone.utc) if parsed.tzinfo is None else parsed.astimezone(timezone.utc)


def resolve_time(token: str, now: datetime) -> datetime | None:
    """`now`, `now-15m` or an ISO time; None when unreadable."""
    relative = _RELATIVE.fullmatch(token.strip())
    if relative:
        amount, unit = relative.groups()
        return instant(now) - (timedelta(**{_UNIT[unit]: int(amount)}) if amount else timedelta())
    try:
        return instant(token)
    except ValueError:
        return None


def resolve_range(start: str, end: str, now: datetime) -> tuple[datetime, datetime] | None:
    """Both ends resolved against one `now`; None when unreadable or empty."""
    low, high = resolve_time(start, now), resolve_time(end, now)
    return None if low is None or high is None or low >= high else (low, high)


def ends_at_fixed_time(end: str) -> bool:
    """A fixed end shows nothing new on refresh."""
    return _RELATIVE.fullmatch(end.strip()) is None


def full_day_end(day: str) -> datetime:
    """Last millisecond of a day, for closed ranges given as bare dates."""
    return instant(day[:10]) + timedelta(days=1) - timedelta(milliseconds=1)


def interval_ms(text: str) -> int | None:
    """Milliseconds in `30s`, `5m`, `1d`; None for other text."""
    match = re.fullmatch(r"(\d+)([smhdw])", text)
    if not match:
        return None
    return int(timedelta(**{_UNIT[match[2]]: int(match[1])}).total_seconds() * 1000)


def histogram_interval(start: str | datetime, end: str | datetime) -> str:
    """The narrowest width that splits ``[start, end)`` into at most 60 buckets."""
    span = instant(end) - instant(start)
    seconds = int(span.total_seconds())
    if seconds > 0:
        for name, width in HISTOGRAM_WIDTHS.items():
            if seconds <= width * MAX_BUCKETS:
                return name
    raise ValueError("the time range is empty, backwards or too long")


def time_lit(value: str | datetime) -> Column:
    return F.lit(instant(value)).cast("timestamp")


# -- columns ---------------------------------------------------------------


def rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text with zone; anything else is null."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


def local(ts: Column, tz: str | None) -> Column:
    return ts if tz is None else F.from_utc_timestamp(ts, tz)


def week_start(day: Column) -> Column:
    """Weeks start on Sunday."""
    return F.date_sub(F.next_day(day, "SUN"), 7)


def closed(ts: Column, start, end) -> Column:
    """``start <= ts <= end``; a bare end date means its midnight."""
    return (ts >= time_lit(start)) & (ts <= time_lit(end))


def half_open(ts: Column, start, end) -> Column:
    return (ts >= time_lit(start)) & (ts < time_lit(end))


def bucket_start(ts: Column, width_s: int) -> Column:
    """Start of the epoch-aligned bucket a time falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width_s) * width_s)


def duration_text(ms: Column) -> Column:
    """`850ms`, `3.2s`, `4m 05s`, `2h 07m`, `3d 4h`."""
    ms = ms.cast("double")
    minutes = F.floor(ms / 60_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(ms.isNull() | F.isnan(ms) | (ms < 0), F.lit("—"))
        .when(ms < 1_000, F.format_string("%dms", F.round(ms).cast("long")))
        .when(ms < 60_000, F.format_string("%.1fs", ms / 1_000))
        .when(minutes < 60, F.format_string("%dm %02ds", minutes, F.floor(ms / 1_000) % 60))
        .when(hours < 24, F.format_string("%dh %02dm", hours, minutes % 60))
        .otherwise(F.format_string("%dd %dh", F.floor(hours / 24), hours % 24))
    )


def offset_text(ms: Column) -> Column:
    return F.concat(F.lit("+"), duration_text(F.greatest(F.lit(0), ms)))


def bucket_label(ts: Column, interval: str, span_ms: int) -> Column:
    """Axis label, as coarse as the width and the covered span allow."""
    width = interval_ms(interval) or 0
    if width >= 86_400_000:
        pattern = "MMM d"
    elif span_ms > 86_400_000:
        pattern = "MMM d HH:mm"
    elif width >= 60_000:
        pattern = "HH:mm"
    else:
        pattern = "HH:mm:ss"
    return F.date_format(ts, pattern)
