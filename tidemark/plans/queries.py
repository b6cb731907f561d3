"""Every operator as a query over the sample tables, for the correctness gate and the benchmark.

Dates and times are presented as ISO text so that engines agree on how they look.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import addresses, documents, names, props, times
from tidemark.model import Scope
from tidemark.operators import behaviour, catalog, explore, filters, ingest, metrics, shape
from tidemark.plans import library, saved
from tidemark.session import scratch_dir, use_utc
from tidemark.sources import events as sources
from tidemark.sources.sample import ORG, sample_events, sample_facts, sample_payloads, table
from tidemark.streaming import archive, batches, cycles, jobs, sinks

Query = Callable[[SparkSession, str], DataFrame]

RANGE = ("2024-01-01", "2024-02-01")
START, END = "2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z"
TREE = {"range": {"occured_at": {"gte": START, "lt": END}}}
NOW = datetime(2024, 1, 20, 10, 0, tzinfo=timezone.utc)
STEPS = ("view", "click", "purchase")
SIX_HOURS = 21_600
KOLKATA = "Asia/Kolkata"

_QUERIES: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Dates as `yyyy-MM-dd`, times as `yyyy-MM-dd HH:mm:ss.SSS`, sums of counts as bigint."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def query(run: Query, name: str | None = None) -> Query:
    def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(run(use_utc(spark), sf_dir))

    _QUERIES[name or run.__name__] = checked
    return run


def on_facts(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(lambda spark, sf_dir: build(sample_facts(spark, sf_dir)), name)


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- metric library --------------------------------------------------------

on_facts("daily_event_volume", lambda ev: metrics.daily_event_volume(ev, RANGE))
on_facts("daily_event_volume_local", lambda ev: metrics.daily_event_volume(ev, RANGE, KOLKATA))
on_facts("event_distribution", lambda ev: metrics.event_distribution(ev, RANGE))
on_facts("events_by_platform", lambda ev: metrics.events_by_property(ev, RANGE, "platform"))
on_facts("events_by_device", lambda ev: metrics.events_by_property(ev, RANGE, "device_type"))
on_facts("events_by_browser", lambda ev: metrics.events_by_property(ev, RANGE, "browser", 10))
on_facts("events_by_country", lambda ev: metrics.events_by_country(ev, RANGE))
on_facts("hourly_distribution", lambda ev: metrics.hourly_distribution(ev, RANGE))
on_facts("weekly_trend", lambda ev: metrics.weekly_trend(ev, RANGE))
on_facts("monthly_trend", lambda ev: metrics.monthly_trend(ev, RANGE))
on_facts("month_start_counts", lambda ev: metrics.month_start_counts(ev, RANGE))
on_facts("specific_event_count", lambda ev: metrics.specific_event_count(ev, "purchase", RANGE))
on_facts("unique_users", lambda ev: metrics.unique_users(ev, RANGE))
on_facts("daily_active_users", lambda ev: metrics.daily_active_users(ev, RANGE))
on_facts("top_cities", lambda ev: metrics.events_by_property(ev, RANGE, "city", 20))
on_facts("available_events", lambda ev: metrics.available_events(ev))
on_facts("property_distribution", lambda ev: metrics.property_distribution(ev, "click", "rank", RANGE))
on_facts(
    "mean_reciprocal_rank",
    lambda ev: metrics.mean_reciprocal_rank(ev, "click", "rank", RANGE).select(F.round("mrr", 9).alias("mrr")),
)
on_facts("reciprocal_position", lambda ev: metrics.reciprocal_position(ev, "click", "rank"))
on_facts(
    "boolean_crosstab",
    lambda ev: metrics.boolean_crosstab(ev, F.col("authenticated"), F.col("source") == "web", F.col("country").isNotNull()),
)
on_facts("event_names", metrics.event_names)
on_facts("events_today", lambda ev: metrics.events_today(ev, NOW, KOLKATA))
on_facts(
    "value_share",
    lambda ev: metrics.value_share(metrics.event_distribution(ev, RANGE), ev.agg(F.count(F.lit(1))).scalar()),
)


@query
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library run by name: rows each date-ranged metric returns."""
    ev, dates = sample_facts(spark, sf_dir), dict(zip(("start_date", "end_date"), RANGE))
    parts = [
        library.run_metric(m.name.upper(), ev, dates).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(m.id).alias("id"), "rows")
        for m in library.LIBRARY
        if m.params == ("start_date", "end_date")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- behaviour -------------------------------------------------------------


def _steps() -> list:
    return [F.col("event_name") == name for name in STEPS]


on_facts("window_funnel", lambda ev: behaviour.funnel_levels(ev, _steps(), SIX_HOURS))
on_facts("funnel_cumulative", lambda ev: behaviour.funnel(ev, STEPS, SIX_HOURS))
on_facts("consecutive_gap", lambda ev: behaviour.consecutive_gap(ev, "view"))
on_facts("consecutive_similarity", lambda ev: behaviour.consecutive_similarity(ev, "view", "query"))
on_facts("session_timeline", lambda ev: behaviour.session_timeline(ev))
on_facts(
    "session_strip_position",
    lambda ev: behaviour.strip_position(ev).withColumn("position", F.round("position", 6)),
)
on_facts("flow_edges", behaviour.flow_edges)
on_facts("flow_break_cycles", lambda ev: shape.break_cycles(behaviour.flow_edges(ev)))
on_facts("flow_acyclic", lambda ev: shape.acyclic_flow(shape.break_cycles(behaviour.flow_edges(ev))))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s-"), "l_suppkey").alias("actor_id"),
        F.col("l_returnflag").alias("event_name"),
        F.col("l_shipdate").cast("timestamp").alias("event_timestamp"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
    )


@query
def funnel_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.funnel(_shipments(spark, sf_dir), ("N", "A", "R"), 30 * 86_400)


@query
def gap_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.consecutive_gap(_shipments(spark, sf_dir), "R")


# -- predicates ------------------------------------------------------------

_PILLS = [
    {"field": "name", "operator": "is_one_of", "values": ["view", "click", "signup"]},
    {"field": "source", "operator": "is", "value": "ios", "negate": True},
    {"field": "actor_id", "operator": "exists"},
    {"field": "session_id", "operator": "exists", "disabled": True},
]

TREES = {
    "p_match_all": {"match_all": {}},
    "p_term": {"term": {"properties.platform": {"value": "ios"}}},
    "p_terms": {"terms": {"system_properties.geo.country": ["IN", "DE"]}},
    "p_term_list_item": {"term": {"properties.cart.items": "7"}},
    "p_match": {"match": {"name": "view"}},
    "p_match_phrase": {"match_phrase": {"authenticated": True}},
    "p_range": {"range": {"occured_at": {"gte": "2024-01-05T00:00:00", "lt": "2024-01-09", "time_zone": "+05:30"}}},
    "p_range_relative": {"range": {"@timestamp": {"gte": "now-7d/d", "lte": "now"}}},
    "p_range_text": {"range": {"properties.rank": {"gte": "2", "lt": "30"}}},
    "p_exists": {"exists": {"field": "properties.device_type"}},
    "p_prefix": {"prefix": {"session_id": "s-1"}},
    "p_wildcard": {"wildcard": {"properties.query": "*shoes ?xx*"}},
    "p_ids": {"ids": {"values": ["1", "77", "400", "no-such-event"]}},
    "p_bool": {
        "bool": {
            "must": [{"term": {"source": "web"}}],
            "should": [{"term": {"name": "view"}}, {"exists": {"field": "session_id"}}],
            "minimum_should_match": 1,
            "must_not": [{"term": {"properties.device_type": "mobile"}}],
        }
    },
    "p_text_and_or_not": {
        "bool": {
            "filter": [
                {"match": {"name": "purchase"}},
                {"bool": {"must_not": [{"exists": {"field": "actor_id"}}]}},
            ]
        }
    },
    "p_pills": filters.pills_tree(_PILLS, (datetime(2024, 1, 3), datetime(2024, 1, 28))),
    "p_pill_replace": filters.pills_tree(
        filters.add_pill(
            filters.add_pill([], {"field": "name", "operator": "is", "value": "view"}),
            {"field": "name", "operator": "is", "value": "view", "negate": True},
        )
    ),
}


def _by_name(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count"))


for _name, _tree in TREES.items():
    on_facts(_name, lambda ev, tree=_tree: _by_name(filters.search(ev, tree=tree, now=NOW)))

on_facts("p_time_halfopen", lambda ev: _by_name(ev.where(filters.time_halfopen(F.col("event_timestamp"), "2024-01-05", "2024-01-09"))))
on_facts("p_time_closed", lambda ev: _by_name(ev.where(filters.time_closed(F.col("event_timestamp"), "2024-01-05", times.full_day_end("2024-01-09")))))


@query
def p_time_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = times.resolve_range("now-7d", "now", NOW)
    return _by_name(sample_facts(spark, sf_dir).where(filters.time_halfopen(F.col("event_timestamp"), start, end)))


on_facts("p_like", lambda ev: _by_name(ev.where(names.name_like(F.col("event_name"), "i"))))


@query
def p_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = sample_facts(spark, sf_dir)
    scopes = [Scope(ORG, f"workspace-{n}") for n in range(3)]
    parts = [
        filters.search(ev, scope, {"term": {"org_id": ORG}}).groupBy("workspace_id", "event_name").agg(F.count(F.lit(1)).alias("event_count"))
        for scope in scopes
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


on_facts("p_workspace_ingest", lambda ev: _by_name(ingest.own_workspace(ev, "workspace-1")))


# -- exploring -------------------------------------------------------------

on_facts("count_matching", lambda ev: explore.count_matching(ev, tree=TREES["p_bool"]))
on_facts("histogram", lambda ev: explore.histogram(ev, "2024-01-01T07:30:00Z", "2024-01-31T00:00:00Z"))
on_facts(
    "histogram_selection",
    lambda ev: explore.histogram_selection(explore.histogram(ev, START, END), "12h", 20, 5),
)
on_facts("facets", lambda ev: explore.facets(ev, "session_id", tree=TREE, size=20))
on_facts("facet_prefix", lambda ev: explore.facets(ev, "actor_id", tree=TREE, prefix="user-1"))
on_facts("facet_value_text", lambda ev: explore.facets(ev, "authenticated", tree=TREE))
on_facts("sessions_list", lambda ev: explore.sessions(ev, tree=TREE))
on_facts("session_duration", lambda ev: explore.with_duration(explore.sessions(ev, tree=TREE), "duration"))
on_facts("session_facts", explore.session_facts)
on_facts("session_values", explore.session_values)
on_facts("session_event_names", explore.session_event_names)
_PAGE = ["event_id", "event_timestamp", "event_name", "workspace_id"]
on_facts("events_page", lambda ev: explore.event_rows(ev, tree=TREE, size=100).select(*_PAGE))
on_facts(
    "events_page_after",
    lambda ev: explore.event_rows(
        ev, order="asc", size=50, cursor=explore.encode_cursor([1705312800000, "5000"])
    ).select(*_PAGE),
)
on_facts("session_events_page", lambda ev: explore.event_rows(ev, order="asc", session_id="s-7-20240103").select(*_PAGE))
on_facts(
    "sessions_page",
    lambda ev: explore.session_rows(ev, tree=TREE, size=100, cursor=explore.encode_cursor(["s-12-20240115"])),
)


@query
def get_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event asked for in every scope; only its own has it."""
    ev = sample_facts(spark, sf_dir)
    parts = [explore.get_event(ev, Scope(ORG, f"workspace-{n}"), "0").select(*_PAGE) for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


on_facts("event_public", lambda ev: explore.public_event(ev).drop("properties"))
on_facts(
    "top_values_sample",
    lambda ev: explore.top_values_sample(explore.page_items(ev, size=100), "properties.device_type"),
)


# -- catalog ---------------------------------------------------------------


def _docs(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Half of the events described, one with an empty text; coupons and ranks described everywhere."""
    found = metrics.event_names(ev).where("event_name in ('click', 'purchase', 'view')")
    text = F.when(F.col("event_name") == "view", "").otherwise(F.concat(F.lit("about "), "event_name"))
    events = found.select("event_name", text.alias("description"))
    listed = F.explode(F.array(F.lit("rank"), F.lit("cart.coupon"), F.lit("city")))
    properties = found.select("event_name", listed.alias("property")).withColumn(
        "description", F.when(F.col("property") == "city", "").otherwise(F.concat_ws(" of ", "property", "event_name"))
    )
    return events, properties


on_facts("schema_catalog", catalog.schema_catalog)
on_facts("schema_catalog_list", lambda ev: catalog.schema_catalog_list(catalog.schema_catalog(ev)))
on_facts("event_property_keys", lambda ev: catalog.event_property_keys(ev, "click"))
on_facts("unnest", catalog.leaf_paths)
on_facts("field_catalog", catalog.field_catalog)
on_facts("join_schema_docs", lambda ev: catalog.schema_docs(catalog.schema_catalog_list(catalog.schema_catalog(ev)), *_docs(ev)))
on_facts("join_undocumented", lambda ev: catalog.undocumented(catalog.schema_catalog(ev), _docs(ev)[1], ["event_name", "property"]))
on_facts(
    "documentation_coverage",
    lambda ev: catalog.documentation_coverage(metrics.event_names(ev), catalog.schema_catalog(ev), *_docs(ev)),
)
on_facts("schema_search", lambda ev: catalog.schema_search(metrics.event_names(ev), catalog.schema_catalog(ev), "ICK"))


@query
def sink_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = sample_facts(spark, sf_dir)
    stamped = lambda df, at: df.withColumn("updated_at", F.lit(at).cast("timestamp"))
    base = stamped(_docs(ev)[0], "2024-01-01").withColumn("created_at", F.lit("2023-12-31").cast("timestamp"))
    updates = metrics.event_names(ev).where("event_name >= 'p'").withColumn("description", F.lit("new text"))
    return catalog.upsert_descriptions(base, stamped(updates, "2024-02-02"), ["event_name"])


# -- ingest ----------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parts of hourly requests per visitor."""
    return sample_facts(spark, sf_dir).select(
        F.concat_ws("/", "anon_id", F.date_format("event_timestamp", "yyyyMMddHH")).alias("request_id"),
        F.col("event_id").cast("long").alias("pos"),
        "org_id",
        "event_name",
        F.lit(ORG).alias("request_org"),
        "workspace_id",
        F.when(F.col("event_id").cast("long") % 301 == 7, "workspace-9").otherwise(F.col("workspace_id")).alias("request_workspace"),
    )


@query
def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ingest.check_scope(_requests(spark, sf_dir))
    return checked.select("request_id", "pos", "rejected_at")


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workspaces have a set, the third takes everything; sets come from the events themselves."""
    sets = sample_facts(spark, sf_dir).select("org_id", "workspace_id", "event_name").distinct()
    return sets.where("workspace_id = 'workspace-0' and event_name in ('view', 'click') or workspace_id = 'workspace-1' and event_name = 'error'")


@query
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ingest.allow_events(sample_facts(spark, sf_dir), _allowed(spark, sf_dir))
    return judged.groupBy("workspace_id", "event_name", "allowed").agg(F.count(F.lit(1)).alias("event_count"))


@query
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.collection_status(ingest.allow_events(_requests(spark, sf_dir), _allowed(spark, sf_dir)))


on_facts(
    "mark_authenticated",
    lambda ev: ingest.with_authenticated(ev, F.col("source") == "web")
    .groupBy("source", "authenticated")
    .agg(F.count(F.lit(1)).alias("event_count")),
)


def _enriched(ev: DataFrame) -> DataFrame:
    """Some events without arrival time, some with their own address, and the request's address."""
    late = F.when(F.col("event_id").cast("long") % 4 == 0, F.lit(None)).otherwise(F.col("arrived_at"))
    user = F.regexp_extract("anon_id", r"(\d+)$", 1).cast("long")
    return ev.withColumns(
        {
            "arrived_at": late,
            "ip_address": F.when(F.col("event_id").cast("long") % 5 == 0, "9.9.9.9"),
            "request_ip": F.concat(user % 30, F.lit("."), user % 7, F.lit(".0."), user % 250),
        }
    )


on_facts(
    "enrich_arrived_at",
    lambda ev: ingest.enrich_arrived_at(_enriched(ev), "2024-03-01T12:00:00Z").select("event_id", "arrived_at"),
)
on_facts("enrich_ip", lambda ev: ingest.enrich_ip(_enriched(ev), "request_ip").select("event_id", "ip_address"))
on_facts("public_ip", lambda ev: _enriched(ev).select("event_id", addresses.is_public_ip(F.col("request_ip")).alias("is_public")))


@query
def client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _enriched(sample_facts(spark, sf_dir))
    number = F.col("event_id").cast("long")
    forwarded = F.when(number % 4 == 0, F.concat("request_ip", F.lit(", 10.0.0.1"))).when(number % 4 == 1, " ,10.0.0.1")
    real = F.when(number % 3 == 0, F.lit(" 7.7.7.7 "))
    return ev.select("event_id", names.client_ip(forwarded, real, F.lit("5.5.5.5")).alias("client_ip"))


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One IPv4 /8 and one IPv6 /32 block per nation."""
    nation = table(spark, sf_dir, "nation")
    block, name = F.hex(F.col("n_nationkey").cast("long")), F.concat(F.lit("N"), F.col("n_nationkey") % 10).alias("range_country")
    v4 = nation.select(F.concat("n_nationkey", F.lit(".0.0.0")).alias("lo"), F.concat("n_nationkey", F.lit(".255.255.255")).alias("hi"), name)
    rest = ":".join(["ffff"] * 6)
    v6 = nation.select(F.concat(F.lit("2a00:"), block, F.lit("::")).alias("lo"), F.concat(F.lit("2a00:"), block, F.lit(f":{rest}")).alias("hi"), name)
    return v4.unionByName(v6)


@query
def enrich_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event asks by an IPv6 address of the same block."""
    ev = _enriched(sample_facts(spark, sf_dir))
    block = F.hex(F.split_part("request_ip", F.lit("."), F.lit(1)).cast("long"))
    wide = F.concat(F.lit("2A00:"), block, F.lit("::7:"), F.split_part("request_ip", F.lit("."), F.lit(4)))
    asked = ev.withColumn("request_ip", F.when(F.col("event_id").cast("long") % 2 == 1, wide).otherwise(F.col("request_ip")))
    return ingest.enrich_country(asked, ip_ranges(spark, sf_dir), "request_ip").select("event_id", "country")


def _versions(ev: DataFrame) -> DataFrame:
    """Every event once more: a third as a later deletion, the rest as an exact copy."""
    number = F.col("event_id").cast("long")
    later = F.when(number % 3 == 0, F.col("updated_at") + F.expr("interval 1 hour")).otherwise(F.col("updated_at"))
    again = ev.withColumns({"updated_at": later, "is_deleted": F.when(number % 3 == 0, 1).otherwise(0).cast("byte")})
    return ev.unionByName(again)


on_facts("dedup_events", lambda ev: ingest.dedup(_versions(ev)).select("event_id", "updated_at", "is_deleted"))
on_facts("soft_delete", lambda ev: ingest.drop_deleted(_versions(ev)).select("event_id", "event_name"))
on_facts(
    "slug_check",
    lambda ev: ev.select(
        "event_id", names.is_slug(F.col("anon_id")).alias("anon_ok"), names.is_slug(F.col("session_id")).alias("session_ok")
    ),
)


@query
def validate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.decode(sample_payloads(spark, sf_dir)).select("partition", "offset", "error_class", "error_reason")


@query
def conform_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = ingest.decode(sample_payloads(spark, sf_dir, resend=False)).where("error_class is null")
    rows = ingest.conform(decoded, F.lit("2024-03-01").cast("timestamp"))
    return rows.withColumn("platform", props.text_at(F.col("properties"), "platform")).drop("properties")


@query
def hour_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = ingest.classify_archive(sample_payloads(spark, sf_dir))
    return classified.groupBy("reason", "org", "workspace", "dt", "hour").agg(F.count(F.lit(1)).alias("payloads"))


OVERRIDES = [
    (ORG, None, "events-dedicated"),
    (ORG, "workspace-2", "events-{org_id}-eu"),
    ("Bad Org", "workspace-1", "Not A Valid Index"),
]


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "org_id string, workspace_id string, value string")


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the org each payload claims."""
    odd = f"case when event_id % 991 = 2 then 'Bad Org' when event_id % 983 = 3 then '' else '{ORG}' end"
    return sample_events(spark, sf_dir).select(
        "event_id", F.expr(odd).alias("org_id"), F.expr("concat('workspace-', user_id % 3)").alias("workspace_id")
    )


@query
def resolve_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = ingest.resolve_setting(_tenants(spark, sf_dir), _overrides(spark), "events-{org_id}")
    return settled.groupBy("org_id", "workspace_id", "template").agg(F.count(F.lit(1)).alias("events"))


@query
def destination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = ingest.resolve_setting(_tenants(spark, sf_dir), _overrides(spark), "events-{org_id}")
    return (
        ingest.check_destination(settled)
        .groupBy("org_id", "workspace_id", "destination", "error_class")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query
def topic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ingest.check_topic(_tenants(spark, sf_dir), "in.{org_id}.{workspace_id}")
    return checked.groupBy("topic_name", "topic_ok").agg(F.count(F.lit(1)).alias("events"))


@query
def size_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = jobs.prepare(sample_payloads(spark, sf_dir, resend=False), max_bytes=740)
    return prepared.groupBy("error_class").agg(F.count(F.lit(1)).alias("records"))


@query
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_payloads(spark, sf_dir, resend=False).select("offset", documents.one_line(F.col("value")).alias("value"))
    return rows.select(
        "offset",
        F.col("value").contains("\n").alias("has_break"),
        F.get_json_object("value", "$.id").alias("id"),
    )


@query
def default_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = F.parse_json(F.lit('{"platform":"unset","theme":"dark","device_type":"unknown"}'))
    rows = ingest.with_defaults(sample_facts(spark, sf_dir), defaults)
    return rows.select(
        "event_id",
        *[props.text_at(F.col("properties"), p).alias(p) for p in ("platform", "theme", "device_type")],
    )


on_facts("nested_property_audit", lambda ev: ev.select("event_id", ingest.has_nested(F.col("properties")).alias("nested")))


def storefront_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as storefront events: completed checkouts with their lines, and started ones."""
    item = F.concat(
        F.lit('{"quantity":'), F.col("l_quantity").cast("long"), F.lit(',"variant":{"sku":"sku-'), "l_partkey",
        F.lit('","id":"v-'), "l_suppkey", F.lit('","product":{"id":"p-'), "l_partkey",
        F.lit('"},"price":{"amount":'), "l_extendedprice", F.lit("}}}"),
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("text")))), lambda r: r["text"])).alias("items"))
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.expr(
        "case o_orderkey % 4 when 0 then 'checkout_completed' when 1 then 'checkout_started' when 2 then 'product_added_to_cart' else 'clicked' end"
    )
    body = F.concat(
        F.lit('{"id":"sh-'), "o_orderkey", F.lit('","name":"'), name, F.lit('","clientId":" c-'), "o_custkey",
        F.lit('","data":{"checkout":{"email":"'), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat("o_custkey", F.lit("@example.com"))),
        F.lit('","billingAddress":{"phone":"555-'), "o_custkey", F.lit('"},"order":{"id":'), "o_orderkey",
        F.lit(',"customer":{"id":"cu-'), "o_custkey", F.lit('"}},"totalPrice":{"amount":'), "o_totalprice",
        F.lit('},"currencyCode":"EUR","lineItems":['), F.coalesce("items", F.lit("")), F.lit("]}}}"),
    )
    return orders.select(documents.whole_json(body).alias("document"))


@query
def storefront_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.conform_storefront(storefront_documents(spark, sf_dir))
    p = F.col("properties")
    return rows.select(
        "event_name",
        F.concat_ws(",", F.try_element_at("identifiers", F.lit("cookie"))).alias("cookie"),
        F.concat_ws(",", F.try_element_at("identifiers", F.lit("email"))).alias("email"),
        F.concat_ws(",", F.try_element_at("identifiers", F.lit("phone"))).alias("phone"),
        F.concat_ws(",", F.try_element_at("identifiers", F.lit("shopify_customer_id"))).alias("customer"),
        props.text_at(p, "order_id").alias("order_id"),
        F.round(props.double_at(p, "amount"), 2).alias("amount"),
        F.size(F.try_variant_get(p, "$.items", "array<variant>")).cast("long").alias("items"),
        F.try_variant_get(p, "$.items[0].sku", "string").alias("first_sku"),
    )


# -- sources ---------------------------------------------------------------


def _event_json(suffix: str, properties: str) -> list:
    """Parts of a canonical event's JSON, with an id of its own."""
    return [
        F.lit('{"envelop_version":"1.0","id":"'), F.expr(f"regexp_replace(md5(concat(event_id, '{suffix}')), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')"),
        F.lit('","name":"'), F.col("event_type"), F.lit('","occured_at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit(f'","org_id":"{ORG}","workspace_id":"workspace-'), F.col("user_id") % 3, F.lit('","anon_id":"anon-'), F.col("user_id"),
        F.lit(f'"{properties}}}'),
    ]


@query
def src_batch_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a batch of two; one batch in 50 has an unsound event, one in three no system properties."""
    own = ',"system_properties":{"timezone":"own"}'
    broken = F.when(F.col("event_id") % 50 == 9, ',{"id":5}').otherwise("")
    system = F.when(F.col("event_id") % 3 == 0, "").otherwise(',"system_properties":{"timezone":"batch"}')
    body = F.concat(F.lit('{"events":['), *_event_json("a", own), F.lit(","), *_event_json("b", own), broken, F.lit("]"), system, F.lit("}"))
    bodies = sample_events(spark, sf_dir).select("event_id", body.alias("body"))
    doc = F.col("document")
    return sources.explode_batches(bodies).select(
        "event_id", "pos", documents.text(doc, "id").alias("id"), documents.text(doc, "system_properties.timezone").alias("timezone")
    )


@query
def src_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a body of two lines; one body in 40 ends in garbage."""
    tail = F.when(F.col("event_id") % 40 == 3, "\n{oops").otherwise("\n")
    body = F.concat(*_event_json("a", ""), F.lit("\n"), *_event_json("b", ""), tail)
    bodies = sample_events(spark, sf_dir).select("event_id", body.alias("body"))
    return sources.split_concatenated(bodies).select("event_id", "pos", documents.text(F.col("document"), "id").alias("id"))


#: Bytes of a row group of a log whose batches are single files.
LOG_GROUP = 1 << 20


def _stored_log(spark: SparkSession, sf_dir: str, label: str) -> tuple[str, DataFrame]:
    """The payload log written once as files, and a stream over them."""
    root = scratch_dir(spark, label)
    sample_payloads(spark, sf_dir).write.parquet(f"{root}/log")
    return root, sources.read_event_stream(spark, f"{root}/log")


@query
def src_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written by workspace and month, then read back scope by scope for a time range."""
    root = scratch_dir(spark, "facts")
    sinks.write_facts(sample_facts(spark, sf_dir), root, 0)
    rng = ("2024-01-05", "2024-01-25")
    parts = [sources.facts(spark, root, Scope(ORG, f"workspace-{n}"), rng) for n in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("workspace_id", "event_name").agg(F.count(F.lit(1)).alias("event_count"))


@query
def merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, then other versions and deletions of them in a later batch; merged, and read with one more fresh batch."""
    root, ev = scratch_dir(spark, "merge-facts"), sample_facts(spark, sf_dir)
    sinks.write_facts(ev, root, 0)
    sinks.merge_facts(spark, root)
    sinks.write_facts(_versions(ev), root, 1)
    sinks.merge_facts(spark, root)
    sinks.write_facts(ev, root, 2)
    return sources.facts(spark, root).select("event_id", "event_name")


@query
def sink_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload log streamed into the fact table, resends and all, read back without copies."""
    root, stream = _stored_log(spark, sf_dir, "stream-facts")
    jobs.start_fact_sink(stream, f"{root}/facts", f"{root}/checkpoint").awaitTermination()
    rows = sources.facts(spark, f"{root}/facts")
    return rows.select("event_id", "event_name", "event_timestamp", "workspace_id", "actor_id", "country")


@query
def facts_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload log as many batches, resends in other batches; the ingest merges as it goes, the rest is read fresh."""
    root = scratch_dir(spark, "facts-batches")
    # A task reads whole row groups, so a batch of one file is spread by small ones.
    log = sample_payloads(spark, sf_dir).repartition(2 * sinks.FANOUT + 3)
    log.write.option("parquet.block.size", LOG_GROUP).parquet(f"{root}/log")
    stream = sources.read_event_stream(spark, f"{root}/log", files_per_trigger=1)
    jobs.start_fact_sink(stream, f"{root}/facts", f"{root}/checkpoint").awaitTermination()
    return sources.facts(spark, f"{root}/facts").groupBy("workspace_id", "event_name").agg(F.count(F.lit(1)).alias("event_count"))


@query
def sink_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, stream = _stored_log(spark, sf_dir, "stream-catalog")
    jobs.start_catalog_sink(stream, f"{root}/catalog", f"{root}/checkpoint").awaitTermination()
    return sinks.read_catalog(spark, f"{root}/catalog")


@query
def sink_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload log archived by a stream and read back: every copy of every payload, byte for byte."""
    root, stream = _stored_log(spark, sf_dir, "stream-archive")
    jobs.start_archive(stream, f"{root}/archive", f"{root}/checkpoint", seconds=None).awaitTermination()
    rows = sources.read_archive(spark, f"{root}/archive", once=False)
    return rows.select("org", "workspace", "dt", "hour", F.md5("value").alias("digest"))


@query
def src_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archived day range of one workspace, one payload per event id."""
    root = scratch_dir(spark, "archive")
    classified = ingest.classify_archive(sample_payloads(spark, sf_dir))
    archive.write_archive(classified, root)
    days = ("2024-01-03", "2024-01-20")
    parts = [sources.read_archive(spark, root, Scope(ORG, f"workspace-{n}"), days) for n in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("workspace", "dt").agg(F.count(F.lit(1)).alias("payloads"))


# -- sinks -----------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify_archive(sample_payloads(spark, sf_dir))


@query
def sink_archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests that an archiving stream stored beside its objects, summed up by folder."""
    root, stream = _stored_log(spark, sf_dir, "archive-manifest")
    jobs.start_archive(stream, f"{root}/archive", f"{root}/checkpoint", seconds=None, source="sample", created_at="2024-03-01T00:00:00Z").awaitTermination()
    return archive.folder_manifests(archive.read_manifests(spark, f"{root}/archive"))


@query
def sink_archive_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects that are there after two streams have archived the same log to the same place."""
    root, stream = _stored_log(spark, sf_dir, "archive-twice")
    for run in range(2):
        jobs.start_archive(stream, f"{root}/archive", f"{root}/checkpoint-{run}", n=1_000, seconds=None).awaitTermination()
    objects = archive.read_manifests(spark, f"{root}/archive").withColumn("range", F.split("ranges", ":"))
    offsets = [F.element_at("range", at).cast("long").alias(c) for at, c in ((-2, "first_offset"), (-1, "last_offset"))]
    return objects.select(sinks.archive_key("backup").alias("object_key"), "event_count", *offsets)


@query
def trigger_n_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in cycles of exactly 100 records per partition; what is left fires by time."""
    root, stream = _stored_log(spark, sf_dir, "cycles")
    running = cycles.start_cycles(stream, 100, 1, f"{root}/out", f"{root}/checkpoint")
    try:
        cycles.await_records(running, f"{root}/out", spark.read.parquet(f"{root}/log").count(), 1_800)
    finally:
        running.stop()
    fired = cycles.read_cycles(spark, f"{root}/out").groupBy("topic", "partition", "cycle", "by")
    return fired.agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query
def linger_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as bulk requests of at most 50 documents or 32 KiB."""
    records = sample_payloads(spark, sf_dir).withColumn("size", F.octet_length("value"))
    return batches.batch_sizes(batches.linger_batches(records, 50, 32 * 1024))


@query
def sink_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.quarantine(_classified(spark, sf_dir))


@query
def sink_search_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create-once by id: a fifth of the ids exist already, every event comes twice."""
    ev = sample_facts(spark, sf_dir)
    existing = ev.where(F.col("country") == "IN")
    return ingest.upsert_by_id(_versions(ev), existing).select("event_id", "event_name")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.prepare(sample_payloads(spark, sf_dir))


@query
def sink_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = sinks.unique_letters(sinks.dead_letters(_prepared(spark, sf_dir), "2024-03-01T00:00:00Z"))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return letters.select(
        "key",
        "partition",
        "offset",
        header("dlq.error.class").alias("error_class"),
        header("dlq.source.offset").alias("source_offset"),
        header("dlq.failed_at").alias("failed_at"),
    )


@query
def sink_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written below their destination and counted from the folders."""
    root = scratch_dir(spark, "routed")
    good = _prepared(spark, sf_dir).where("error_class is null").select("event_id", "destination")
    sinks.write_routed(good, root, 0)
    stored = spark.read.schema("event_id string, batch_id long, destination string").parquet(root)
    return stored.groupBy("destination").agg(F.count(F.lit(1)).alias("records"))


@query
def sink_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per visitor: events, and whether all of them lie in one partition."""
    keyed = sinks.repartition_by_visitor(sample_facts(spark, sf_dir).select("anon_id", "event_timestamp"))
    return keyed.withColumn("_part", F.spark_partition_id()).groupBy("anon_id").agg(
        F.count(F.lit(1)).alias("events"), (F.min("_part") == F.max("_part")).alias("together")
    )


@query
def sink_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _classified(spark, sf_dir).where("reason is null").groupBy("dt").agg(F.count(F.lit(1)).alias("payloads"))
    return sinks.expire(days, NOW)


@query
def sink_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns written as CSV and read back."""
    path = f"{scratch_dir(spark, 'export')}/csv"
    shape.export_csv(sample_facts(spark, sf_dir), path, ["id", "occured_at", "name", "properties.cart", "properties.query"])
    schema = "occured_at string, id string, name string, cart string, query string"
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', enforceSchema=True)


@query
def sink_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole public events, times and nested properties among them, written as JSON lines and read back."""
    path = f"{scratch_dir(spark, 'export')}/json"
    public = explore.public_event(sample_facts(spark, sf_dir))
    shape.export_json(public, path)
    kinds = {f.name: f.dataType.simpleString() for f in public.schema.fields}
    kinds["properties"] = "struct<cart: struct<coupon: string, items: array<bigint>>, query: string>"
    rows = spark.read.schema(", ".join(f"{name} {kind}" for name, kind in kinds.items())).json(path)
    items = F.concat_ws(",", F.col("properties.cart.items").cast("array<string>"))
    found = {"coupon": F.col("properties.cart.coupon"), "items": items, "query": F.col("properties.query")}
    return rows.withColumns(found).drop("properties")


@query
def sink_metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric run, asked again within 30 s (kept) and with a failing query later (old result stays)."""
    root, ev = scratch_dir(spark, "snapshots"), sample_facts(spark, sf_dir)
    run = lambda: metrics.event_distribution(ev, RANGE)
    saved.refresh_metric(spark, "volume", run, root, NOW)
    _, kept_at, _ = saved.refresh_metric(spark, "volume", lambda: run().limit(1), root, NOW + timedelta(seconds=30))
    later = NOW + timedelta(hours=1)
    rows, ran_at, error = saved.refresh_metric(spark, "volume", lambda: run().select("nothing"), root, later)
    aged = F.lit(int((later - ran_at).total_seconds())).cast("long")
    return rows.withColumns({"kept": F.lit(kept_at == ran_at), "failed": F.lit(error is not None), "age_s": aged})


@query
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ingest_counters(_prepared(spark, sf_dir))


@query
def dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole replay check on the payload log: what was sent against what a create-once sink holds."""
    path = f"{scratch_dir(spark, 'audit')}/prepared"
    jobs.write_outcomes(_prepared(spark, sf_dir), path)
    prepared = spark.read.parquet(path)
    sound = F.when(F.col("error_class").isNull(), F.col("event_id")).alias("event_id")
    sent = prepared.select("topic", "partition", "offset", "org_id", "workspace_id", sound)
    written = sent.where("event_id is not null").select(*ingest.ID_KEY).distinct()
    letters = sinks.dead_letters(prepared, "2024-03-01")
    return sinks.dedup_audit(sent, written, letters)


# -- streams ---------------------------------------------------------------


@query
def stream_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ingest as one stream: how many records each sink ends up with."""
    root, stream = _stored_log(spark, sf_dir, "stream-ingest")
    jobs.start_ingest(stream, root, f"{root}/checkpoint").awaitTermination()
    stored = {
        "facts": sources.facts(spark, f"{root}/facts"),
        "dead_letters": spark.read.parquet(f"{root}/dead_letters"),
        "archive": sources.read_archive(spark, f"{root}/archive", once=False),
        "quarantine": spark.read.parquet(f"{root}/_quarantine"),
        "catalog": sinks.read_catalog(spark, f"{root}/catalog"),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(sink).alias("sink"), "rows") for sink, df in stored.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def _event_stream(spark: SparkSession, sf_dir: str, label: str) -> tuple[str, DataFrame]:
    root, stream = _stored_log(spark, sf_dir, label)
    return root, ingest.conform(ingest.decode(stream).where("error_class is null"))


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed, resends dropped by (org, workspace, id) however late they come."""
    root, stream = _event_stream(spark, sf_dir, "stream-dedup")
    kept = stream.select("org_id", "workspace_id", "event_id", "event_name", "event_timestamp", "arrived_at")
    jobs.start_deduped(kept, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("event_id string, event_name string").parquet(f"{root}/out").select("event_id", "event_name")


@query
def live_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, stream = _event_stream(spark, sf_dir, "stream-histogram")
    jobs.start_histogram(stream.select("event_timestamp"), "12h", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return jobs.read_histogram(spark, f"{root}/out")


@query
def auto_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relative-range count refreshed by a stream of arrivals."""
    root, stream = _stored_log(spark, sf_dir, "stream-refresh")

    def run(session: SparkSession, now: datetime) -> DataFrame:
        start, end = times.resolve_range("now-7d", "now", now)
        return _by_name(sample_facts(session, sf_dir).where(filters.time_halfopen(F.col("event_timestamp"), start, end)))

    jobs.start_refresh(stream, run, f"{root}/out", f"{root}/checkpoint", None, lambda: NOW).awaitTermination()
    return jobs.latest_refresh(spark, f"{root}/out")


# -- shaping ---------------------------------------------------------------


@query
def metric_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace's own metric: events by day and name, with each day's total."""
    metric = saved.SavedMetric(
        keys=(saved.Key("day", "event_timestamp", "day"), saved.Key("event_name", "event_name")),
        measures=(saved.Measure("events", "count"),),
        sets=(("day", "event_name"), ("day",)),
        having=(saved.Condition("events", ">", 0),),
        order=(("day", "ASC"), ("event_name", "ASC")),
    )
    return saved.run_metric(sample_facts(spark, sf_dir), Scope(ORG, "workspace-1"), metric)


_VARIABLES = {
    "start": saved.Variable("date", "2024-01-10"),
    "term": saved.Variable(
        "searchable_dropdown", "i",
        saved.SavedMetric(
            keys=(saved.Key("event_name", "event_name"),),
            where=(saved.Condition("event_name", "contains", saved.Param("term")),),
        ),
    ),
    "size": saved.Variable("number", "1"),
    "way": saved.Variable("direction", "DESC"),
}


@query
def metric_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved metric whose values come from variables, one of them given."""
    metric = saved.SavedMetric(
        keys=(saved.Key("event_name", "event_name"),),
        measures=(saved.Measure("events", "count"),),
        where=(
            saved.Condition("event_timestamp", ">=", saved.Param("start")),
            saved.Condition("event_name", "contains", saved.Param("term")),
            saved.Condition("event_name", ">=", saved.Param("size"), "length"),
        ),
        order=(("events", saved.Param("way")),),
    )
    return saved.run_saved(sample_facts(spark, sf_dir), Scope(ORG, "workspace-0"), metric, _VARIABLES, {"size": "5"})


@query
def metric_dropdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a searchable variable offers for a typed term."""
    return saved.dropdown(sample_facts(spark, sf_dir), Scope(ORG, "workspace-0"), "term", _VARIABLES, {}, "e")


@query
def metric_of_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric over another one's rows: per name, days, busiest day and mean of a day's known users."""
    daily = saved.SavedMetric(
        keys=(saved.Key("day", "event_timestamp", "day"), saved.Key("event_name", "event_name")),
        measures=(
            saved.Measure("events", "count"),
            saved.Measure("users", "distinct", "actor_id", (saved.Condition("actor_id", "is_set"),)),
        ),
    )
    metric = saved.SavedMetric(
        source=daily,
        keys=(saved.Key("event_name", "event_name"),),
        measures=(saved.Measure("days", "count"), saved.Measure("busiest", "max", "events"), saved.Measure("users", "sum", "users")),
    )
    return saved.run_metric(sample_facts(spark, sf_dir), Scope(ORG, "workspace-1"), metric)


on_facts(
    "pivot_matrix",
    lambda ev: shape.pivot_matrix(
        ev.select("event_name", "source", props.text_at(F.col("properties"), "rank").alias("rank")),
        "event_name", "source", "rank",
    ),
)


def _daily(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.to_date("event_timestamp").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(F.nullif("actor_id", F.lit(""))).alias("users")
    )


on_facts("series_multi", lambda ev: shape.to_series(_daily(ev), "day", ["events", "users"]))
on_facts(
    "minmax_normalise",
    lambda ev: shape.minmax_normalise(_daily(ev), "day", ["events", "users"]).withColumn("scaled", F.round("scaled", 6)),
)
on_facts(
    "top10_of_many",
    lambda ev: shape.top_slices(metrics.events_by_property(ev, RANGE, "city").withColumnRenamed("event_count", "n"), "city", "n"),
)
on_facts("reverse_order", lambda ev: shape.reverse(metrics.event_distribution(ev, RANGE), [("count", True), ("event_name", False)]))
on_facts(
    "doc_summary",
    lambda ev: shape.doc_summary(ev).select(
        "event_id", F.concat_ws("|", F.transform("summary", lambda e: F.concat_ws("=", e["path"], e["text"]))).alias("summary")
    ),
)
on_facts(
    "redact",
    lambda ev: ev.select(
        "event_id",
        names.redact(F.concat(F.lit("cannot read events-"), "org_id", F.lit(" of "), "org_id"), F.lit(f"events-{ORG}"), F.col("org_id")).alias("text"),
    ),
)
