"""Searching events: pages, sessions, histograms and facets."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidemark.functions import props, times
from tidemark.model import FACET_FIELDS, Scope
from tidemark.operators.filters import Tree, field_column, prefix_filter, require_time_range, search, time_halfopen

DEFAULT_PAGE, MAX_PAGE = 50, 100
DEFAULT_FACETS, MAX_FACETS = 5, 50


# -- cursors and pages -----------------------------------------------------


@dataclass(frozen=True)
class Page:
    """At most ``size`` rows and the cursor of the next page (None on the last)."""

    items: list[Row]
    next_cursor: str | None


def encode_cursor(key: Sequence[Any]) -> str:
    text = json.dumps(list(key), separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, length: int) -> list[Any]:
    try:
        if not cursor or cursor.strip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"):
            raise ValueError(cursor)
        key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        raise ValueError("the cursor is not valid") from None
    if not isinstance(key, list) or len(key) != length:
        raise ValueError("the cursor is not valid")
    return key


def page_size(requested: int | None) -> int:
    if requested is None:
        return DEFAULT_PAGE
    if not 1 <= requested <= MAX_PAGE:
        raise ValueError(f"the page size must be between 1 and {MAX_PAGE}")
    return requested


def as_page(rows: DataFrame, size: int, key: Callable[[Row], list[Any]]) -> Page:
    """Collects the ``size + 1`` rows of a page query; the extra one only tells that more follow."""
    found = rows.take(size + 1)
    items = found[:size]
    return Page(items, encode_cursor(key(items[-1])) if len(found) > size else None)


def event_rows(
    ev: DataFrame,
    scope: Scope | None = None,
    tree: Tree | None = None,
    order: str = "desc",
    size: int | None = None,
    cursor: str | None = None,
    session_id: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """The rows of one page plus one: by event time, then id ascending in both orders.

    A cursor resumes after its key, so pages neither skip nor repeat a row and none is re-sorted from
    the start: each task keeps only a heap of ``size + 1`` rows.
    """
    size, rows = page_size(size), search(ev, scope, tree, now)
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    if cursor is not None:
        at_ms, after_id = decode_cursor(cursor, 2)
        if not isinstance(at_ms, int) or not isinstance(after_id, str):
            raise ValueError("the cursor is not valid")
        at = F.timestamp_millis(F.lit(at_ms))
        time = F.col("event_timestamp")
        rows = rows.where((time > at if order == "asc" else time < at) | ((time == at) & (F.col("event_id") > after_id)))
    by_time = F.col("event_timestamp").asc() if order == "asc" else F.col("event_timestamp").desc()
    return public_event(rows).orderBy(by_time, "event_id").limit(size + 1)


def page_items(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, **options) -> DataFrame:
    """The rows of one page, without the one that only tells whether another page follows."""
    rows = event_rows(ev, scope, tree, **options)
    return rows.limit(page_size(options.get("size")))


def events_page(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, **options) -> Page:
    rows = event_rows(ev, scope, tree, **options)
    rows = rows.withColumn("_ms", F.unix_millis("event_timestamp"))
    return as_page(rows, page_size(options.get("size")), lambda row: [row["_ms"], row["event_id"]])


def session_events_page(ev: DataFrame, session_id: str, scope: Scope | None = None, order: str = "asc", **options) -> Page:
    """One session's events, oldest first."""
    return events_page(ev, scope, order=order, session_id=session_id, **options)


def public_event(df: DataFrame) -> DataFrame:
    """Events leave the system without their org."""
    return df.drop("org_id")


def get_event(ev: DataFrame, scope: Scope, event_id: str) -> DataFrame:
    """One event by id, only when it is the scope's own."""
    return public_event(search(ev, scope).where(F.col("event_id") == event_id)).limit(1)


def count_matching(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, now=None) -> DataFrame:
    return search(ev, scope, tree, now).agg(F.count(F.lit(1)).alias("count"))


# -- sessions --------------------------------------------------------------


def sessions(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, now=None) -> DataFrame:
    """Per session: first and last event and their number, over the matching events only."""
    require_time_range(tree)
    rows = search(ev, scope, tree, now).where("session_id != ''")
    return rows.groupBy("session_id").agg(
        F.min("event_timestamp").alias("first_event_at"),
        F.max("event_timestamp").alias("last_event_at"),
        F.count(F.lit(1)).alias("event_count"),
    )


def session_rows(
    ev: DataFrame,
    scope: Scope | None = None,
    tree: Tree | None = None,
    size: int | None = None,
    cursor: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One page of sessions plus one, by id; a cursor cuts the events before they are grouped."""
    size = page_size(size)
    if cursor is not None:
        after = decode_cursor(cursor, 1)[0]
        if not isinstance(after, str):
            raise ValueError("the cursor is not valid")
        ev = ev.where(F.col("session_id") > after)
    return sessions(ev, scope, tree, now).orderBy("session_id").limit(size + 1)


def sessions_page(ev: DataFrame, scope: Scope | None = None, tree: Tree | None = None, **options) -> Page:
    rows = session_rows(ev, scope, tree, **options)
    return as_page(rows, page_size(options.get("size")), lambda row: [row["session_id"]])


# What a session list may be sorted by.
_SESSION_SORTS = {
    "session": "session_id",
    "started": "first_event_at",
    "last": "last_event_at",
    "duration": "duration_ms",
    "events": "event_count",
}


def with_duration(summary: DataFrame, sort: str | None = "last", descending: bool = True) -> DataFrame:
    """Adds the duration and sorts by any column, latest activity first by default."""
    length = F.unix_millis("last_event_at") - F.unix_millis("first_event_at")
    rows = summary.withColumn("duration_ms", length).withColumn("duration_text", times.duration_text(length))
    if sort is None:
        return rows
    by = F.col(_SESSION_SORTS[sort])
    return rows.orderBy(by.desc() if descending else by.asc(), "session_id")


def _session(ev: DataFrame, session_id: str | None) -> DataFrame:
    return ev.where("session_id != ''") if session_id is None else ev.where(F.col("session_id") == session_id)


def session_facts(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """Per session: duration and number of events."""
    at = F.unix_millis("event_timestamp")
    return _session(ev, session_id).groupBy("session_id").agg(
        (F.max(at) - F.min(at)).alias("duration_ms"), F.count(F.lit(1)).alias("event_count")
    )


def session_values(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """(session_id, field, value): the distinct visitors, actors, sources and countries of a session."""
    fields = ("anon_id", "actor_id", "source", "country")
    listed = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])
    rows = _session(ev, session_id).select("session_id", F.explode(listed).alias("v"))
    return rows.select("session_id", "v.field", "v.value").where("value != ''").distinct()


def session_event_names(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """Per session and event name: how many, most frequent first."""
    rows = _session(ev, session_id)
    counts = rows.groupBy("session_id", "event_name").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("session_id", F.col("count").desc(), "event_name")


# -- histogram -------------------------------------------------------------


def histogram(
    ev: DataFrame,
    start: str | datetime,
    end: str | datetime,
    scope: Scope | None = None,
    tree: Tree | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """(time, count) per bucket over ``[start, end)``, empty buckets included.

    Buckets are multiples of the width since the epoch. The at most 61 empty ones join the events
    as rows that count nothing, before the one aggregation.
    """
    width = times.HISTOGRAM_WIDTHS[times.histogram_interval(start, end)]
    low = int(times.instant(start).timestamp() // width)
    high = int((times.instant(end) - timedelta(milliseconds=1)).timestamp() // width)
    rows = search(ev, scope, tree, now).where(time_halfopen(F.col("event_timestamp"), start, end))
    seen = rows.select(F.floor(F.unix_seconds("event_timestamp") / width).alias("bucket"), F.lit(1).alias("n"))
    empty = ev.sparkSession.range(low, high + 1, 1, 1).select(F.col("id").alias("bucket"), F.lit(0).alias("n"))
    counts = seen.unionByName(empty).groupBy("bucket").agg(F.sum("n").alias("count"))
    return counts.select(F.timestamp_seconds(F.col("bucket") * width).alias("time"), "count").orderBy("time")


def histogram_selection(hist: DataFrame, interval: str, anchor: int, current: int) -> DataFrame:
    """(from, to, count) of a run of buckets, given either way round; empty when outside the chart."""
    width = times.interval_ms(interval) or 0
    first, last = sorted((anchor, current))
    at = F.unix_millis("time")
    bounds = hist.agg(F.min(at).alias("low"), F.count(F.lit(1)).alias("n"))
    low, n = bounds.select("low").scalar(), bounds.select("n").scalar()
    chosen = hist.where(at.between(low + first * width, low + last * width) & (F.lit(last) < n) & F.lit(first >= 0))
    return chosen.agg(
        F.min("time").alias("from"),
        F.timestamp_millis(F.max(at) + width).alias("to"),
        F.sum("count").alias("count"),
    ).where("count is not null")


# -- facets ----------------------------------------------------------------


def facet_text(column: Column) -> Column:
    """Booleans read `true` / `false`; `''` is an absent value."""
    return F.nullif(column.cast("string"), F.lit(""))


def facet_size(field: str, size: int | None) -> int:
    if field not in FACET_FIELDS:
        raise ValueError(f"`{field}` cannot be counted")
    if size is None:
        return DEFAULT_FACETS
    if not 1 <= size <= MAX_FACETS:
        raise ValueError(f"the number of values must be between 1 and {MAX_FACETS}")
    return size


def facets(
    ev: DataFrame,
    field: str,
    scope: Scope | None = None,
    tree: Tree | None = None,
    size: int | None = None,
    prefix: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """The most frequent values of a field: (value, count, total, other).

    `total` is every matching event, `other` the events whose value is not listed. Without any listed value
    one row tells the total, its value and count null.
    """
    size = facet_size(field, size)
    require_time_range(tree)
    rows = search(ev, scope, tree, now).where(prefix_filter(field, prefix))
    counts = rows.groupBy(facet_text(field_column(field)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    # Absent values sort last, so they only ever fill places no value needs. Filtering them after the
    # limit keeps the grouping identical to that of the totals, which then reads the same shuffle.
    listed = counts.orderBy(F.col("value").isNull(), F.col("count").desc(), "value").limit(size).where("value is not null")
    sums = counts.agg(
        F.struct(F.sum("count").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("valued"))
    ).scalar()
    # At most `size` rows are left for this window.
    shown = F.sum("count").over(Window.partitionBy())
    # One row is always there: with no listed value it has none, and only the totals.
    one = counts.sparkSession.range(1).select(F.lit(True).alias("_one"))
    shown_rows = listed.withColumn("_shown", shown).withColumn("_one", F.lit(True))
    return (
        one.join(F.broadcast(shown_rows), "_one", "left")
        .withColumn("_sums", sums)
        .select(
            "value", "count", F.coalesce("_sums.total", F.lit(0)).alias("total"),
            (F.coalesce("_sums.valued", F.lit(0)) - F.coalesce("_shown", F.lit(0))).alias("other"),
        )
        .orderBy(F.col("count").desc(), "value")
    )


# -- sampled values --------------------------------------------------------


def top_values_sample(page: DataFrame, field: str, n: int = 5) -> DataFrame:
    """Top values of any field among the loaded events: (kind, label, count, with_field, sampled).

    Values of different JSON types stay apart (`1` is not `"1"`); null counts as absent.
    """
    if field.startswith("properties."):
        value = props.value_at(F.col("properties"), field.removeprefix("properties."))
        kind = F.when(value.isNotNull() & ~F.is_variant_null(value), props.field_type(F.schema_of_variant(value)))
        label = props.value_label(value)
    else:
        label = F.nullif(field_column(field).cast("string"), F.lit(""))
        kind = F.when(label.isNotNull(), F.lit("boolean" if field == "authenticated" else "string"))
    counts = page.select(kind.alias("kind"), label.alias("label")).groupBy("kind", "label").agg(
        F.count(F.lit(1)).alias("count")
    )
    found = counts.where("kind is not null")
    with_field = found.agg(F.sum("count")).scalar()
    sampled = counts.agg(F.sum("count")).scalar()
    return (
        found.orderBy(F.col("count").desc(), "label", "kind")
        .limit(n)
        .select("kind", "label", "count", with_field.alias("with_field"), sampled.alias("sampled"))
    )
