"""Which properties exist, and which of them are documented."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import props
from tidemark.model import KNOWN_FIELDS
from tidemark.session import small_side

_UNSTORED = ("VOID", "OBJECT<>")


def schema_catalog(ev: DataFrame) -> DataFrame:
    """Distinct (org_id, workspace_id, event_name, property, type); a path with two types has two rows.

    Distinct shapes first: the rows are never multiplied by their number of properties.
    """
    shapes = ev.select("org_id", "workspace_id", "event_name", props.shape_of(F.col("properties")).alias("shape")).distinct()
    leaves = props.leaf_rows(shapes).where(~F.col("stored").isin(*_UNSTORED)).distinct()
    return leaves.select(
        "org_id", "workspace_id", "event_name", F.col("path").alias("property"), props.catalog_type(F.col("stored")).alias("type")
    ).distinct()


def new_catalog_rows(seen: DataFrame, existing: DataFrame) -> DataFrame:
    """Catalog rows that are not yet there."""
    key = ["org_id", "workspace_id", "event_name", "property", "type"]
    return seen.join(existing.select(*key), key, "left_anti")


def schema_catalog_list(catalog: DataFrame) -> DataFrame:
    """One type per (event, property), the first by name."""
    return (
        catalog.groupBy("event_name", "property").agg(F.min("type").alias("type")).orderBy("event_name", "property")
    )


def leaf_paths(df: DataFrame, column: str = "properties") -> DataFrame:
    """(path, type) of every stored leaf of a column."""
    shapes = df.select(props.shape_of(F.col(column)).alias("shape")).distinct()
    leaves = props.leaf_rows(shapes).where(~F.col("stored").isin(*_UNSTORED)).distinct()
    return leaves.select("path", props.catalog_type(F.col("stored")).alias("type")).distinct()


def event_property_keys(ev: DataFrame, name: str) -> DataFrame:
    return leaf_paths(ev.where(F.col("event_name") == name)).select(F.col("path").alias("property")).distinct().orderBy(
        "property"
    )


def field_catalog(ev: DataFrame) -> DataFrame:
    """(position, name, type): the known fields, then every property seen, by name.

    A field's type is its first known one in event order; nulls do not decide it.
    """
    known = ev.sparkSession.createDataFrame(
        [(n, name, kind) for n, (name, kind) in enumerate(KNOWN_FIELDS)], "position int, name string, type string"
    )
    shapes = (
        ev.groupBy(props.shape_of(F.col("properties")).alias("shape"))
        .agg(F.min("event_timestamp").alias("first_seen"))
        .where("shape is not null")
    )
    kinds = props.leaf_rows(shapes).withColumn("kind", props.field_type(F.col("stored")))
    undecided = (F.col("kind") == "unknown").cast("int")
    seen = kinds.groupBy("path").agg(F.min(F.struct(undecided, "first_seen", "kind")).alias("first"))
    extra = seen.select(
        F.lit(len(KNOWN_FIELDS)).alias("position"),
        F.concat(F.lit("properties."), "path").alias("name"),
        F.col("first.kind").alias("type"),
    )
    return known.unionByName(extra).orderBy("position", "name")


# -- documentation ---------------------------------------------------------


def schema_docs(catalog: DataFrame, event_docs: DataFrame, property_docs: DataFrame) -> DataFrame:
    """Catalog rows with the descriptions of their event and property, `''` when there is none."""
    events = small_side(event_docs.select("event_name", F.col("description").alias("event_description")))
    properties = small_side(
        property_docs.select("event_name", "property", F.col("description").alias("property_description"))
    )
    joined = catalog.join(events, "event_name", "left").join(properties, ["event_name", "property"], "left")
    return joined.select(
        "event_name",
        "property",
        "type",
        F.coalesce("event_description", F.lit("")).alias("event_description"),
        F.coalesce("property_description", F.lit("")).alias("property_description"),
    )


def undocumented(catalog: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with no description row (an empty text still counts as a row)."""
    return catalog.select(*key).distinct().join(docs.select(*key), key, "left_anti")


def documentation_coverage(
    names: DataFrame, catalog: DataFrame, event_docs: DataFrame, property_docs: DataFrame
) -> DataFrame:
    """One row: events and properties, how many lack a text, and how many lack a description row."""
    described = lambda docs, key: docs.select(*key, (F.col("description") != "").alias("has_text"))
    events = names.join(described(event_docs, ["event_name"]), "event_name", "left")
    pairs = catalog.select("event_name", "property").distinct()
    properties = pairs.join(
        described(property_docs, ["event_name", "property"]), ["event_name", "property"], "left"
    )
    rows = events.select(F.lit("event").alias("kind"), "has_text").unionByName(
        properties.select(F.lit("property").alias("kind"), "has_text")
    )
    of = lambda kind, extra=F.lit(True): F.count_if((F.col("kind") == kind) & extra)
    no_text, no_row = ~F.coalesce("has_text", F.lit(False)), F.col("has_text").isNull()
    return rows.agg(
        of("event").alias("events"),
        of("event", no_text).alias("events_missing"),
        of("event", no_row).alias("events_undocumented"),
        of("property").alias("properties"),
        of("property", no_text).alias("properties_missing"),
        of("property", no_row).alias("properties_undocumented"),
    )


def schema_search(names: DataFrame, catalog: DataFrame, text: str) -> DataFrame:
    """Events whose name, or any property name or type, holds the text, whatever its case."""
    if not text.strip():
        return names
    wanted = text.lower()
    holds = lambda column: F.lower(column).contains(wanted)
    by_property = catalog.where(holds("property") | holds("type")).select("event_name")
    by_name = names.where(holds("event_name")).select("event_name")
    return names.join(by_property.unionByName(by_name).distinct(), "event_name", "left_semi")


def upsert_descriptions(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Updates replace the text and `updated_at`; `created_at` stays that of the first write."""
    old, new = base.alias("o"), updates.alias("n")
    joined = old.join(new, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in key], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return joined.select(
        *[pick(c) for c in key],
        pick("description"),
        F.coalesce(F.col("o.created_at"), F.col("n.updated_at")).alias("created_at"),
        pick("updated_at"),
    )
