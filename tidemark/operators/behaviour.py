"""Questions about the order of a visitor's events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import props, times
from tidemark.operators.slices import adjacent_pairs, with_neighbours

FUNNEL_WINDOW_S = 1_800
IDLE_S = 30


# -- funnel ----------------------------------------------------------------


def funnel_levels(
    ev: DataFrame, steps: Sequence[Column], window_s: int = FUNNEL_WINDOW_S, actor: str = "actor_id"
) -> DataFrame:
    """(actor, level): the deepest step reached in order within ``window_s`` of the chain's first event.

    Actors that reach no step have no row. Times count in whole seconds and the bound is inclusive.

    A chain never looks back further than the window, so a timeline may be cut into slices that
    each start one window early. Equal seconds merge before the first shuffle; a slice then holds at
    most one row per second, whatever share of the events one actor has.
    """
    slice_s = max(86_400, 8 * window_s)
    hit = sum((F.when(step, 1 << n).otherwise(0) for n, step in enumerate(steps)), F.lit(0))
    seconds = (
        ev.select(F.col(actor).alias("actor"), F.unix_seconds("event_timestamp").alias("t"), hit.alias("hit"))
        .where("hit != 0")
        .groupBy("actor", "t")
        .agg(F.bit_or("hit").alias("hit"))
    )
    own, later = F.floor(F.col("t") / slice_s), F.floor((F.col("t") + window_s) / slice_s)
    rows = seconds.withColumn("slice", F.explode(F.sequence(own, later)))
    upto = Window.partitionBy("actor", "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    satisfies = lambda n: F.col("hit").bitwiseAND(1 << n) != 0
    rows = rows.withColumn("start0", F.when(satisfies(0), F.col("t")))
    for n in range(1, len(steps)):
        # Chain starts only grow, so the last one set is also the latest.
        start = F.last(f"start{n - 1}", ignorenulls=True).over(upto)
        rows = rows.withColumn("start", start).withColumn(
            f"start{n}", F.when(satisfies(n) & (F.col("t") <= F.col("start") + window_s), F.col("start"))
        )
    level = F.greatest(*[F.when(F.col(f"start{n}").isNotNull(), n + 1).otherwise(0) for n in range(len(steps))], F.lit(0))
    reached = rows.groupBy("actor").agg(F.max(level).cast("long").alias("level")).where("level > 0")
    return reached.select(F.col("actor").alias(actor), "level")


def step_name(level: Column, step_names: Sequence[str]) -> Column:
    pairs = [F.lit(item) for n, name in enumerate(step_names) for item in (n + 1, name)]
    return F.try_element_at(F.create_map(*pairs), level.cast("int"))


def funnel(
    ev: DataFrame, step_names: Sequence[str], window_s: int = FUNNEL_WINDOW_S, steps: Sequence[Column] | None = None
) -> DataFrame:
    """(level, event, count): actors that got at least this far; a level nobody stopped at has no row."""
    steps = [F.col("event_name") == name for name in step_names] if steps is None else steps
    stopped = funnel_levels(ev, steps, window_s).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per step is left here.
    deepest_first = Window.orderBy(F.col("level").desc())
    return stopped.select(
        "level",
        step_name(F.col("level"), step_names).alias("event"),
        F.sum("n").over(deepest_first).alias("count"),
    ).orderBy("level")


# -- neighbouring events ---------------------------------------------------


def gap_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 10, "<10s")
        .when(seconds < 30, "10-30s")
        .when(seconds < 60, "30-60s")
        .when(seconds < 300, "1-5min")
        .otherwise("5min+")
    )


def consecutive_gap(ev: DataFrame, name: str, drop_anonymous: bool = False) -> DataFrame:
    """(gap_bucket, pair_count): time from each event to the same actor's next one of that name."""
    rows = ev.where(F.col("event_name") == name)
    rows = rows.where("actor_id != ''") if drop_anonymous else rows
    pairs = adjacent_pairs(rows, "actor_id", "event_timestamp")
    gap = (F.unix_millis("next_ts") - F.unix_millis("ts")) / 1000
    return (
        pairs.groupBy(gap_label(gap).alias("gap_bucket"))
        .agg(F.sum("pairs").alias("pair_count"))
        .orderBy("gap_bucket")
    )


def similarity_label(distance: Column) -> Column:
    return (
        F.when(distance == 0, "identical")
        .when(distance <= 2, "minor_change")
        .when(distance <= 5, "moderate_change")
        .otherwise("major_change")
    )


def consecutive_similarity(ev: DataFrame, name: str, prop: str, drop_anonymous: bool = False) -> DataFrame:
    """(similarity_bucket, pair_count): edit distance from a text property to the actor's next one.

    Distances count bytes of UTF-8. An event without the property breaks the pair.
    """
    rows = ev.where(F.col("event_name") == name)
    rows = rows.where("actor_id != ''") if drop_anonymous else rows
    texts = rows.select("actor_id", "event_timestamp", props.text_at(F.col("properties"), prop).alias("text"))
    pairs = adjacent_pairs(texts, "actor_id", "event_timestamp", "text").where(
        "value is not null and next_value is not null"
    )
    # Equal pairs of texts share one distance.
    distinct = pairs.groupBy("value", "next_value").agg(F.sum("pairs").alias("pairs"))
    as_bytes = lambda text: F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # noqa: E731  one character per byte
    label = similarity_label(F.levenshtein(as_bytes("value"), as_bytes("next_value")))
    return (
        distinct.groupBy(label.alias("similarity_bucket"))
        .agg(F.sum("pairs").alias("pair_count"))
        .orderBy("similarity_bucket")
    )


def flow_edges(ev: DataFrame, key: str = "session_id", name: str = "event_name") -> DataFrame:
    """(source, target, value): how often one event directly follows another in a session."""
    pairs = adjacent_pairs(ev.where(F.col(key) != ""), key, "event_timestamp", name)
    return pairs.groupBy(F.col("value").alias("source"), F.col("next_value").alias("target")).agg(
        F.sum("pairs").alias("value")
    )


# -- one session -----------------------------------------------------------


def session_timeline(
    ev: DataFrame, session_id: str | None = None, idle_s: int = IDLE_S, shown: int = 4
) -> DataFrame:
    """Events with offset from the session start, gap to the previous event, idle flag and first properties.

    ``session_id`` None means every session. Gaps are milliseconds and null on a first event. The labels are cut before the
    rows are shuffled, so whole properties stay where they are read.
    """
    rows = ev.where(F.col("session_id") != "") if session_id is None else ev.where(F.col("session_id") == session_id)
    entries = F.slice(props.flat_entries(F.col("properties")), 1, shown)
    labels = F.transform(entries, lambda e: F.concat_ws("=", e["path"], props.value_label(e["value"])))
    narrow = rows.select("session_id", "event_id", "event_timestamp", "event_name", F.concat_ws(", ", labels).alias("properties_shown"))
    timed = with_neighbours(narrow, "session_id", "event_timestamp", "event_id")
    since = lambda start: F.unix_millis("event_timestamp") - F.unix_millis(start)
    return timed.select(
        "session_id",
        "event_id",
        "event_timestamp",
        "event_name",
        since("first_ts").alias("offset_ms"),
        since("previous_ts").alias("gap_ms"),
        F.coalesce(since("previous_ts") >= idle_s * 1000, F.lit(False)).alias("idle"),
        times.offset_text(since("first_ts")).alias("offset_text"),
        "properties_shown",
    )


def strip_position(ev: DataFrame, session_id: str | None = None) -> DataFrame:
    """Relative position 0..1 of each event between the session's first and last (span at least 1 ms)."""
    rows = ev.where(F.col("session_id") != "") if session_id is None else ev.where(F.col("session_id") == session_id)
    rows = rows.select("session_id", "event_id", "event_name", "event_timestamp")
    span = rows.groupBy("session_id").agg(
        F.min(F.unix_millis("event_timestamp")).alias("_low"), F.max(F.unix_millis("event_timestamp")).alias("_high")
    )
    at = (F.unix_millis("event_timestamp") - F.col("_low")) / F.greatest(F.lit(1), F.col("_high") - F.col("_low"))
    return rows.join(span, "session_id").select(
        "session_id", "event_id", "event_name", at.alias("position")
    )
