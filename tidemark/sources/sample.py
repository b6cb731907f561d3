"""The product-analytics view of the sample tables: events as facts, payloads and requests.

Each adapter is a pure projection of a given table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.model import FACT_COLUMNS

ORG = "org-alpha"

# Display texts of the projection, shared with nothing else.
_K = "cast(get_json_object(props, '$.k') as bigint)"
_DAY = "date_format(ts, 'yyyyMMdd')"
_UUID = r"regexp_replace(md5(cast(event_id as string)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')"

COLUMNS = {
    "k": _K,
    "workspace_id": "concat('workspace-', user_id % 3)",
    "uuid": _UUID,
    "actor_id": "case when user_id % 10 = 0 then '' else concat('user-', user_id) end",
    "anon_id": "concat('anon-', user_id)",
    "session_id": f"case when event_id % 11 = 0 then '' else concat('s-', user_id, '-', {_DAY}) end",
    "source": "case event_id % 3 when 0 then 'web' when 1 then 'ios' else 'android' end",
    "country": "case user_id % 5 when 0 then 'IN' when 1 then 'US' when 2 then 'DE' when 3 then 'GB' end",
    "authenticated": "user_id % 2 = 0",
    "platform": "case user_id % 4 when 0 then 'web' when 1 then 'ios' when 2 then 'android' else '' end",
    "device_type": "case when event_id % 13 = 0 then null when user_id % 3 = 0 then 'desktop' else 'mobile' end",
    "browser": "case when event_id % 17 = 0 then '' else concat('browser-', event_id % 12) end",
    "city": "case when user_id % 6 = 0 then '' else concat('city-', user_id % 25) end",
    "query": "case when event_id % 4 = 0 then 'red shoes' else "
    f"concat('red shoes ', cast(floor(value / 10) as bigint), repeat('x', cast({_K} % 7 as int))) end",
}

# A property object whose `amount` is stored with three types and whose `cart` is nested.
PROPERTIES = f"""concat(
    '{{"k":', {_K}, ',"platform":"', {COLUMNS["platform"]}, '"',
    coalesce(concat(',"device_type":"', {COLUMNS["device_type"]}, '"'), ''),
    ',"browser":"', {COLUMNS["browser"]}, '","city":"', {COLUMNS["city"]},
    '","rank":', {_K} + 1, ',"query":"', {COLUMNS["query"]}, '","amount":',
    case {_K} % 3 when 0 then '12.5' when 1 then '"12.5"' else '{{"currency":"EUR","cents":1250}}' end,
    ',"cart":{{"coupon":"C', {_K} % 5, '","items":[', {_K}, ',1]}}}}')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with event time as an instant, cut to milliseconds."""
    events = table(spark, sf_dir, "events")
    return events.withColumn("ts", F.date_trunc("millisecond", F.col("ts").cast("timestamp")))


def sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of the fact table."""
    return sample_events(spark, sf_dir).select(
        F.expr(COLUMNS["workspace_id"]).alias("workspace_id"),
        F.lit(ORG).alias("org_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("event_name"),
        F.col("ts").alias("event_timestamp"),
        F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 7, 0)").alias("arrived_at"),
        F.expr(COLUMNS["session_id"]).alias("session_id"),
        F.expr(COLUMNS["anon_id"]).alias("anon_id"),
        F.expr(COLUMNS["actor_id"]).alias("actor_id"),
        F.expr(COLUMNS["source"]).alias("source"),
        F.lit("").alias("correlation_id"),
        F.lit("").alias("trace_id"),
        F.expr(COLUMNS["authenticated"]).alias("authenticated"),
        F.parse_json(F.expr(PROPERTIES)).alias("properties"),
        F.expr(COLUMNS["country"]).alias("country"),
        F.lit("Europe/Berlin").alias("timezone"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ts").alias("inserted_at"),
        F.col("ts").alias("updated_at"),
        F.lit(0).cast("byte").alias("is_deleted"),
    ).select(*FACT_COLUMNS)


#: Payload defects by event id, first match wins; the rest are sound.
DEFECTS = """case
    when event_id % 997 = 1 then 'not_json'
    when event_id % 991 = 2 then 'bad_org'
    when event_id % 983 = 3 then 'no_org'
    when event_id % 977 = 4 then 'no_time'
    when event_id % 211 = 5 then 'line_break'
    else '' end"""

_PAYLOAD = f"""concat('{{"envelop_version":"1.0"', case when defect = 'line_break' then ',\\n' else ',' end,
    '"id":"', uuid, '","name":"', event_type, '"',
    case when defect = 'no_time' then '' else concat(',"occured_at":"', occured, '"') end,
    case when defect = 'no_time' or event_id % 7 = 6 then '' else concat(',"arrived_at":"', arrived, '"') end,
    case defect when 'no_org' then ',"org_id":""' when 'bad_org' then ',"org_id":"Bad Org"'
         else ',"org_id":"{ORG}"' end,
    ',"workspace_id":"', workspace_id, '"',
    case when session_id = '' then '' else concat(',"session_id":"', session_id, '"') end,
    ',"anon_id":"', anon_id, '"',
    case when actor_id = '' then '' else concat(',"actor_id":"', actor_id, '"') end,
    ',"source":"', source, '","authenticated":', case when authenticated then 'true' else 'false' end,
    ',"properties":', properties,
    ',"system_properties":{{"geo":{{"country":"', coalesce(country, 'unknown'), '"}},"timezone":"Europe/Berlin"}}}}')"""


def sample_payloads(spark: SparkSession, sf_dir: str, resend: bool = True) -> DataFrame:
    """The events table as a message log, with defects and (optionally) one event in twenty sent again."""
    events = sample_events(spark, sf_dir)
    columns = {name: F.expr(text) for name, text in COLUMNS.items() if name not in ("k", "query")}
    rich = events.withColumns(columns).withColumns(
        {
            "defect": F.expr(DEFECTS),
            "properties": F.expr(PROPERTIES),
            "occured": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            "arrived": F.expr(
                "date_format(ts + make_interval(0, 0, 0, 0, 0, event_id % 7, 0), \"yyyy-MM-dd'T'HH:mm:ss.SSS'000000Z'\")"
            ),
        }
    )
    payload = F.when(F.col("defect") == "not_json", F.concat(F.lit("oops "), F.col("event_id"))).otherwise(
        F.expr(_PAYLOAD)
    )
    log = rich.select(
        F.col("anon_id").alias("key"),
        payload.alias("value"),
        F.lit("events").alias("topic"),
        (F.col("user_id") % 6).cast("int").alias("partition"),
        (F.col("event_id") * 2).alias("offset"),
    )
    if not resend:
        return log
    again = log.where("offset % 40 = 0").withColumn("offset", F.col("offset") + 1)
    return log.unionByName(again)
