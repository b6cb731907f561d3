"""The metric library: counts, users and rankings over a closed time range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import documents, props, times

Range = tuple[str | datetime, str | datetime] | None


def between(ev: DataFrame, rng: Range) -> DataFrame:
    return ev if rng is None else ev.where(times.closed(F.col("event_timestamp"), *rng))


def top_n(df: DataFrame, by: str, n: int | None, tie: str) -> DataFrame:
    """Largest first, ties by name; per-task heaps, no full sort, when there is a limit."""
    ordered = df.orderBy(F.col(by).desc(), F.col(tie))
    return ordered if n is None else ordered.limit(n)


def _count_by(ev: DataFrame, group: Column, name: str, count: str = "event_count") -> DataFrame:
    return ev.groupBy(group.alias(name)).agg(F.count(F.lit(1)).alias(count))


def _values(ev: DataFrame, prop: str, name: str) -> DataFrame:
    """One property as text, looked up once a row: a filter on it stays above the look-up."""
    return ev.select(documents.fence(props.text_at(F.col("properties"), prop)).alias(name))


def _local(tz: str | None) -> Column:
    return times.local(F.col("event_timestamp"), tz)


def daily_event_volume(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    return _count_by(between(ev, rng), F.to_date(_local(tz)), "date").orderBy("date")


def event_distribution(ev: DataFrame, rng: Range = None, n: int = 20) -> DataFrame:
    return top_n(_count_by(between(ev, rng), F.col("event_name"), "event_name", "count"), "count", n, "event_name")


def events_by_property(ev: DataFrame, rng: Range = None, prop: str = "platform", n: int | None = None) -> DataFrame:
    """Counts by a property's text; absent and empty values are left out."""
    values = _values(between(ev, rng), prop, prop).where(F.col(prop) != "")
    return top_n(_count_by(values, F.col(prop), prop), "event_count", n, prop)


def events_by_country(ev: DataFrame, rng: Range = None, n: int = 20) -> DataFrame:
    rows = between(ev, rng).where("country is not null and country != ''")
    return top_n(_count_by(rows, F.col("country"), "country"), "event_count", n, "country")


def hourly_distribution(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    return _count_by(between(ev, rng), F.hour(_local(tz)), "hour").orderBy("hour")


def weekly_trend(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    return _count_by(between(ev, rng), times.week_start(F.to_date(_local(tz))), "week").orderBy("week")


def monthly_trend(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    return _count_by(between(ev, rng), F.date_format(_local(tz), "yyyy-MM"), "month").orderBy("month")


def month_start_counts(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    start = F.to_date(F.date_trunc("month", _local(tz)))
    return _count_by(between(ev, rng), start, "month_start").orderBy("month_start")


def specific_event_count(ev: DataFrame, name: str, rng: Range = None) -> DataFrame:
    return between(ev, rng).where(F.col("event_name") == name).agg(F.count(F.lit(1)).alias("event_count"))


def unique_users(ev: DataFrame, rng: Range = None, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return between(ev, rng).where("actor_id != ''").agg(count("actor_id").alias("unique_users"))


def daily_active_users(ev: DataFrame, rng: Range = None, tz: str | None = None) -> DataFrame:
    rows = between(ev, rng).where("actor_id != ''").select(F.to_date(_local(tz)).alias("date"), "actor_id")
    return rows.groupBy("date").agg(F.count_distinct("actor_id").alias("unique_users")).orderBy("date")


def available_events(ev: DataFrame, n: int = 100) -> DataFrame:
    return event_names(ev).orderBy("event_name").limit(n)


def event_names(ev: DataFrame) -> DataFrame:
    return ev.select("event_name").distinct()


def events_today(ev: DataFrame, now: str | datetime, tz: str = "Asia/Kolkata") -> DataFrame:
    """Events whose local date is today's; plain bounds on the stored time, so files can be skipped."""
    midnight = F.date_trunc("day", F.from_utc_timestamp(times.time_lit(now), tz))
    start = F.to_utc_timestamp(midnight, tz)
    end = F.to_utc_timestamp(midnight + F.expr("interval 1 day"), tz)
    rows = ev.where((F.col("event_timestamp") >= start) & (F.col("event_timestamp") < end))
    return rows.agg(F.count(F.lit(1)).alias("events_today"))


def property_distribution(ev: DataFrame, name: str, prop: str, rng: Range = None, n: int = 30) -> DataFrame:
    rows = between(ev, rng).where(F.col("event_name") == name)
    values = _values(rows, prop, "property_value").where("property_value is not null")
    counts = _count_by(values, F.col("property_value"), "property_value", "count")
    return top_n(counts, "count", n, "property_value")


def reciprocal(rank: Column) -> Column:
    """1 / rank as floating point does it: infinite at zero."""
    return F.when(rank == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / rank)


def mean_reciprocal_rank(ev: DataFrame, name: str, prop: str, rng: Range = None) -> DataFrame:
    rank = props.double_at(F.col("properties"), prop)
    rows = between(ev, rng).where(F.col("event_name") == name).select(rank.alias("rank"))
    return rows.agg(F.avg(reciprocal(F.col("rank"))).alias("mrr"))


def position_label(inverse: Column) -> Column:
    return (
        F.when(inverse >= 0.5, "top_2").when(inverse >= 0.2, "top_5").when(inverse >= 0.1, "top_10").otherwise("beyond_10")
    )


def reciprocal_position(ev: DataFrame, name: str, prop: str) -> DataFrame:
    rank = props.double_at(F.col("properties"), prop)
    rows = ev.where(F.col("event_name") == name).select(rank.alias("rank")).where("rank is not null")
    return _count_by(rows, position_label(reciprocal(F.col("rank"))), "position_bucket").orderBy("position_bucket")


def boolean_crosstab(df: DataFrame, cond_a: Column, cond_b: Column, where: Column | None = None) -> DataFrame:
    """2×2 counts by two conditions."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(cond_a.alias("dim_a"), cond_b.alias("dim_b")).agg(F.count(F.lit(1)).alias("cnt"))


def value_share(df: DataFrame, total: Column, count: str = "count") -> DataFrame:
    """Adds `share`: percent of a total, one decimal."""
    return df.withColumn("share", F.round(F.try_divide(F.col(count) * 100, total), 1))
