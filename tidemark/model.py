"""The event model: scope, wire fields and the fact table's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Scope:
    """The one organisation and workspace a read is for."""

    org_id: str
    workspace_id: str


#: Rows as a message log delivers them.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

#: The fact table. `''` stands for "not sent" in text columns, as stored by the ingest rules.
FACT_SCHEMA = T.StructType(
    [
        T.StructField("workspace_id", T.StringType()),
        T.StructField("org_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("arrived_at", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("anon_id", T.StringType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("authenticated", T.BooleanType()),
        T.StructField("properties", T.VariantType()),
        T.StructField("country", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("is_deleted", T.ByteType()),
    ]
)
FACT_COLUMNS = FACT_SCHEMA.fieldNames()

#: Wire field -> fact column, for searches and exports that speak the wire names.
WIRE_TO_FACT = {
    "id": "event_id",
    "name": "event_name",
    "occured_at": "event_timestamp",
    "@timestamp": "event_timestamp",
    "arrived_at": "arrived_at",
    "org_id": "org_id",
    "workspace_id": "workspace_id",
    "session_id": "session_id",
    "anon_id": "anon_id",
    "actor_id": "actor_id",
    "source": "source",
    "correlation_id": "correlation_id",
    "trace_id": "trace_id",
    "authenticated": "authenticated",
    "system_properties.geo.country": "country",
    "system_properties.timezone": "timezone",
    "system_properties.ip_address": "ip_address",
}

# The field list shown to users, with display types.
KNOWN_FIELDS = [
    ("name", "string"),
    ("occured_at", "date"),
    ("session_id", "string"),
    ("anon_id", "string"),
    ("actor_id", "string"),
    ("source", "string"),
    ("authenticated", "boolean"),
    ("id", "string"),
    ("arrived_at", "date"),
    ("correlation_id", "string"),
    ("trace_id", "string"),
    ("envelop_version", "string"),
    ("workspace_id", "string"),
    ("system_properties.geo.country", "string"),
    ("system_properties.timezone", "string"),
    ("system_properties.ip_address", "ip"),
]

# Fields whose values may be counted exactly.
FACET_FIELDS = [
    "name",
    "source",
    "session_id",
    "anon_id",
    "actor_id",
    "correlation_id",
    "trace_id",
    "authenticated",
    "envelop_version",
    "system_properties.geo.country",
    "system_properties.timezone",
]

ENVELOP_VERSION = "1.0"
