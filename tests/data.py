"""Small event tables for the tests."""

import json
import uuid

from pyspark.sql import functions as F

from tidemark.model import FACT_COLUMNS

DEFAULTS = {
    "workspace_id": "workspace-a", "org_id": "org-one", "event_name": "click", "event_timestamp": "2026-09-01T10:00:00Z",
    "arrived_at": None, "session_id": "", "anon_id": "anon", "actor_id": "", "source": "", "correlation_id": "", "trace_id": "",
    "authenticated": None, "properties": "{}", "country": None, "timezone": None, "ip_address": None,
    "inserted_at": "2026-09-01T10:00:00Z", "updated_at": "2026-09-01T10:00:00Z", "is_deleted": 0,
}


def facts_of(spark, rows):
    """Fact rows from dicts; whatever a dict leaves out has its default."""
    full = [{**DEFAULTS, "event_id": str(uuid.uuid5(uuid.NAMESPACE_OID, str(n))), **row} for n, row in enumerate(rows)]
    schema = ", ".join(
        f"{c} {'boolean' if c == 'authenticated' else 'int' if c == 'is_deleted' else 'string'}" for c in FACT_COLUMNS
    )
    df = spark.createDataFrame([tuple(r[c] for c in FACT_COLUMNS) for r in full], schema)
    for c in ("event_timestamp", "arrived_at", "inserted_at", "updated_at"):
        df = df.withColumn(c, F.to_timestamp(c))
    return df.withColumn("is_deleted", F.col("is_deleted").cast("byte")).withColumn("properties", F.parse_json("properties"))


def payload(n=0, drop=(), **fields):
    """A canonical event as JSON text."""
    event = {
        "envelop_version": "1.0", "id": str(uuid.uuid5(uuid.NAMESPACE_URL, str(n))), "name": "page_view",
        "occured_at": "2026-09-01T10:00:00Z", "org_id": "org-one", "workspace_id": "workspace-a", "anon_id": f"anon-{n}",
    } | fields
    return json.dumps({k: v for k, v in event.items() if k not in drop})


def log_of(spark, values, topic="events", partition=0):
    rows = [(f"k{n}", v, topic, partition, n) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long")
