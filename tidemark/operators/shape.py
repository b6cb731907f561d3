"""Result shaping for charts, tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import props
from tidemark.model import WIRE_TO_FACT
from tidemark.operators.filters import field_column
from tidemark.session import cut_lineage


# -- charts ----------------------------------------------------------------


def _as_number(column: Column, kind: T.DataType) -> Column:
    """The value as a number, reading empty text and null as 0; null when it is not one."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(column.cast("double"), F.lit(0.0))
    text = F.trim(column.cast("string"))
    number = F.when(text.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), text.cast("double"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(number)


def pivot_matrix(df: DataFrame, x: str, y: str, value: str, y_values: Sequence[str] | None = None) -> DataFrame:
    """Cross-tab of two dimensions: a cell sums its values if all are numbers, else counts them; empty is 0."""
    number = _as_number(F.col(value), df.schema[value].dataType)
    cells = (
        df.select(F.col(x).cast("string").alias(x), F.col(y).cast("string").alias(y), number.alias("_number"))
        .groupBy(x, y)
        .agg(F.sum("_number").alias("_sum"), F.count("_number").alias("_numbers"), F.count(F.lit(1)).alias("_rows"))
    )
    cell = F.when(F.col("_numbers") == F.col("_rows"), F.col("_sum")).otherwise(F.col("_rows").cast("double"))
    matrix = cells.withColumn("_cell", cell).groupBy(x).pivot(y, list(y_values) if y_values else None)
    return matrix.agg(F.first("_cell")).na.fill(0.0)


def to_series(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """(series, x, y): each column becomes a series named after it."""
    return df.unpivot([x], [F.col(y).cast("double").alias(y) for y in ys], "series", "y").select("series", x, "y")


def minmax_normalise(df: DataFrame, x: str, ys: Sequence[str]) -> DataFrame:
    """Series scaled to 0–100 between their own extremes; a flat series is 0. The value itself is kept."""
    series = to_series(df, x, ys)
    extremes = df.agg(
        F.struct(*[F.struct(F.min(F.col(y).cast("double")).alias("low"), F.max(F.col(y).cast("double")).alias("high")).alias(y) for y in ys])
    ).scalar()
    of = lambda part: F.coalesce(
        *[F.when(F.col("series") == y, F.col("_extremes")[y][part]) for y in ys]
    )
    low, high = of("low"), of("high")
    scaled = F.when(high > low, (F.col("y") - low) / (high - low) * 100).otherwise(F.lit(0.0))
    return series.withColumn("_extremes", extremes).select(
        "series", x, scaled.alias("scaled"), F.col("y").alias("original")
    )


def top_slices(df: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """The largest rows, and how many categories there are in all."""
    categories = df.agg(F.count(F.lit(1))).scalar()
    top = df.select(label, value).orderBy(F.col(value).desc(), label).limit(n)
    return top.select(label, value, categories.alias("categories"))


def reverse(df: DataFrame, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """The opposite of an order given as (column, descending) pairs."""
    return df.orderBy(*[F.col(c).asc() if descending else F.col(c).desc() for c, descending in by])


def break_cycles(edges: DataFrame) -> DataFrame:
    """Flags the edges to drop, lightest first, so that the flow has no cycle: adds `removed`.

    Taking the lightest edge on any cycle, again and again, removes exactly the edges (s, t) for which a
    path t → s of heavier edges exists. So one best-path closure answers it: per pair of nodes, the path
    whose lightest edge is heaviest, found by doubling. Edges weigh by (value, source, target). The pairs
    are of event names, not of events.
    """
    weight = F.struct(F.col("value"), F.col("source"), F.col("target"))
    links = edges.select("source", "target", "value").withColumn("weight", weight)
    paths = cut_lineage(
        links.where("source != target").select(
            F.col("source").alias("start"), F.col("target").alias("end"), F.col("weight").alias("lightest")
        )
    )
    while True:
        first, second = paths.alias("a"), paths.alias("b")
        longer = first.join(second, (F.col("a.end") == F.col("b.start")) & (F.col("a.start") != F.col("b.end"))).select(
            F.col("a.start").alias("start"),
            F.col("b.end").alias("end"),
            F.least(F.col("a.lightest"), F.col("b.lightest")).alias("lightest"),
        )
        best = cut_lineage(paths.unionByName(longer).groupBy("start", "end").agg(F.max("lightest").alias("lightest")))
        settled = best.join(paths, ["start", "end", "lightest"], "left_anti").isEmpty()
        paths = best
        if settled:
            break
    back = paths.select(F.col("start").alias("target"), F.col("end").alias("source"), F.col("lightest").alias("_back"))
    closed = (F.col("source") == F.col("target")) | F.coalesce(F.col("_back") > F.col("weight"), F.lit(False))
    return links.join(back, ["source", "target"], "left").select("source", "target", "value", closed.alias("removed"))


def acyclic_flow(flagged: DataFrame) -> DataFrame:
    """The edges that `break_cycles` leaves, each with the number of edges it removed from the whole flow.

    A flow without any edge left gives one row with the number and no edge.
    """
    total = flagged.agg(F.count_if("removed").alias("removed_edges"), F.count_if(~F.col("removed")).alias("_left"))
    left = flagged.where("not removed").select("source", "target", "value", total.select("removed_edges").scalar().alias("removed_edges"))
    types = {f.name: f.dataType for f in flagged.schema.fields}
    nothing = [F.lit(None).cast(types[c]).alias(c) for c in ("source", "target", "value")]
    return left.unionByName(total.where("_left = 0").select(*nothing, "removed_edges"))


# -- documents -------------------------------------------------------------

# Fields that open a document's summary, and fields it leaves out.
SUMMARY_FIRST = ("name", "session_id", "anon_id", "actor_id", "source")
SUMMARY_SKIP = ("occured_at", "workspace_id", "envelop_version")
_SYSTEM = ("system_properties.geo.country", "system_properties.ip_address", "system_properties.timezone")
_REST = ("arrived_at", "authenticated", "correlation_id", "id", "trace_id")


def _named(field: str) -> Column:
    """A one-element list (field, text), empty when the event lacks the field."""
    column = field_column(field)
    text = iso(column) if field in ("occured_at", "arrived_at") else column.cast("string")
    entry = F.struct(F.lit(field).alias("path"), text.alias("text"))
    none = F.array().cast("array<struct<path:string,text:string>>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(F.array(entry))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def doc_summary(ev: DataFrame) -> DataFrame:
    """(event_id, summary): the leading fields, then properties, system properties and the rest by name.

    Each row is summarised where it is; nothing is shuffled.
    """
    entries = F.transform(
        props.flat_entries(F.col("properties")),
        lambda e: F.struct(F.concat(F.lit("properties."), e["path"]).alias("path"), props.value_label(e["value"]).alias("text")),
    )
    none = F.array().cast("array<struct<path:string,text:string>>")
    summary = F.concat(
        *[_named(f) for f in SUMMARY_FIRST],
        F.coalesce(F.array_sort(entries), none),
        *[_named(f) for f in _SYSTEM],
        *[_named(f) for f in _REST],
    )
    return ev.select("event_id", summary.alias("summary"))


# -- export ----------------------------------------------------------------


def export_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Flat text rows with the same columns on every row: the chosen ones after the event time, else all seen.

    Lists and objects become JSON text.
    """
    if columns:
        fields = ["occured_at", *[c for c in columns if c != "occured_at"]]
    else:
        from tidemark.operators.catalog import field_catalog

        # The union of keys is a schema: as many names as the export has columns.
        seen = [row["name"] for row in field_catalog(df).select("name").collect()]
        fields = [f for f in seen if f.startswith("properties.") or f in WIRE_TO_FACT or f == "envelop_version"]
    timed = ("occured_at", "arrived_at")
    cell = lambda f: iso(field_column(f)) if f in timed else field_column(f).cast("string")
    return df.select(*[cell(f).alias(f) for f in fields])


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; quotes are doubled, and empty text and null are both empty cells."""
    export_rows(df, columns).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue=""
    )


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)
