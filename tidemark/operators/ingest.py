"""From payloads to facts: decode, check, enrich, route and de-duplicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions import documents, names, props, times
from tidemark.functions.addresses import address_key, is_public_ip, key_bucket, number_key
from tidemark.model import ENVELOP_VERSION, FACT_COLUMNS
from tidemark.session import fits_broadcast

# -- decode and conform ----------------------------------------------------


def _read(raw: DataFrame, value: str) -> DataFrame:
    """The raw rows with `document`, `_fields`, what the event model reads of them (`_<field>`), and `error_reason`.

    A field is looked up once. The lambdas around `_system` and `_geo` keep these projections out of whole-stage code, whose one
    method would be too long for the JVM to compile.
    """
    fields, system, geo = F.col("_fields"), F.col("_system"), F.col("_geo")
    inside = lambda of, name: documents.fence(props.let(documents.fields_of(documents.field(of, name)), lambda own: own))
    parsed = raw.withColumn("document", documents.fence(documents.whole_json(F.col(value))))
    parsed = parsed.withColumn("_fields", documents.fence(documents.fields_of(F.col("document"))))
    kinds = documents.kind_checks(fields)
    taken = parsed.withColumns(
        {
            "_system": inside(fields, "system_properties"),
            **{f"_is_{name}": sound for name, sound in kinds.items()},
            **{f"_{name}": documents.field_text(fields, name) for name in documents.TEXT_FIELDS},
            **{f"_{name}": documents.field(fields, name) for name in ("authenticated", "properties")},
        }
    )
    own = taken.withColumns(
        {
            "_geo": inside(system, "geo"),
            **{f"_{name}": documents.fence(documents.read_text(name, F.col(f"_{name}"))) for name in ("id", "occured_at", "arrived_at")},
        }
    )
    found = {name: F.col(f"_{name}") for name in documents.TEXT_FIELDS}
    problem = documents.event_problem(fields.isNotNull(), {name: F.col(f"_is_{name}") for name in kinds}, found, ENVELOP_VERSION)
    problem = F.coalesce(problem, documents.system_problem(system, geo))
    reason = F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit("empty payload")).otherwise(
        F.concat(F.lit("not a canonical event: "), problem)
    )
    return own.withColumn("error_reason", documents.fence(reason))


def opened(raw: DataFrame, value: str = "value") -> DataFrame:
    """`decode` with the document's `_fields`: a caller that reads on needs no second look into the document."""
    sound = F.col("error_reason").isNull()
    return _read(raw, value).select(
        *raw.columns,
        F.when(sound, F.col("document")).alias("document"),
        F.when(~sound, "decode").alias("error_class"),
        "error_reason",
        F.when(sound, F.col("_fields")).alias("_fields"),
    )


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds `document` (VARIANT), `error_class` and `error_reason`; sound rows have no error."""
    return opened(raw, value).drop("_fields")


def norm_country(country: Column) -> Column:
    """A country is kept only when it has exactly two characters."""
    return F.when(F.length(country) == 2, country)


def conform(decoded: DataFrame, now: Column | None = None, document: str = "document") -> DataFrame:
    """Canonical documents as fact rows: renamed, system properties lifted, absent text as `''`."""
    opened = decoded.withColumn("_fields", documents.fence(documents.fields_of(F.col(document))))
    fields = F.col("_fields")
    system_properties = documents.field(fields, "system_properties")
    found = {name: documents.read_text(name, documents.field_text(fields, name)) for name in documents.TEXT_FIELDS}
    found |= {name: documents.field(fields, name) for name in ("authenticated", "properties")}
    lifted = {path: props.stored_as(system_properties, path) for path in ("geo.country", "timezone", "ip_address")}
    return _as_facts(opened, found, lifted, now)


def conform_sound(raw: DataFrame, now: Column | None = None, value: str = "value") -> DataFrame:
    """`conform` of the rows that `decode` finds sound, by one look into each document."""
    system, geo = F.col("_system"), F.col("_geo")
    found = {name: F.col(f"_{name}") for name in (*documents.TEXT_FIELDS, "authenticated", "properties")}
    country = F.coalesce(documents.field(geo, "country"), documents.field(system, "geo.country"))
    lifted = {"geo.country": country, **{name: documents.field(system, name) for name in ("timezone", "ip_address")}}
    sound = _read(raw, value).where("error_reason is null")
    return _as_facts(sound, found, {path: props.text_stored(given) for path, given in lifted.items()}, now)


def _as_facts(rows: DataFrame, found: Mapping[str, Column], lifted: Mapping[str, Column], now: Column | None) -> DataFrame:
    """Fact rows of an event's own fields and of its system properties, by path."""
    now = F.current_timestamp() if now is None else now
    sent = lambda name: F.coalesce(found[name], F.lit(""))
    facts = {
        "workspace_id": sent("workspace_id"),
        "org_id": sent("org_id"),
        "event_id": found["id"],
        "event_name": sent("name"),
        "event_timestamp": times.millis(found["occured_at"]),
        "arrived_at": times.millis(found["arrived_at"]),
        **{c: sent(c) for c in ("session_id", "anon_id", "actor_id", "source", "correlation_id", "trace_id")},
        "authenticated": F.try_variant_get(found["authenticated"], "$", "boolean"),
        "properties": found["properties"],
        "country": props.let(lifted["geo.country"], norm_country),  # a lambda, as in `_read`
        "timezone": lifted["timezone"],
        "ip_address": lifted["ip_address"],
        "inserted_at": now,
        "updated_at": now,
        "is_deleted": F.lit(0).cast("byte"),
    }
    return rows.select(*[facts[c].alias(c) for c in FACT_COLUMNS])


def own_workspace(df: DataFrame, workspace_id: str) -> DataFrame:
    """Another workspace's events never enter a workspace's tables."""
    return df.where(F.col("workspace_id") == workspace_id)


# -- versions --------------------------------------------------------------

VERSION_KEY = ("org_id", "workspace_id", "event_name", "event_timestamp", "event_id")
#: An id is unique inside one workspace of one org.
ID_KEY = ("org_id", "workspace_id", "event_id")


def dedup(ev: DataFrame, key: tuple[str, ...] = VERSION_KEY) -> DataFrame:
    """One row per key, the greatest `updated_at`; among equals a deletion, then the later arrival.

    The rank filter is applied before the shuffle too, so copies of a row collapse where they are read.
    """
    latest = Window.partitionBy(*key).orderBy(
        F.col("updated_at").desc(),
        F.col("is_deleted").desc(),
        F.col("inserted_at").desc(),
        F.col("arrived_at").desc_nulls_last(),
    )
    return ev.withColumn("_version", F.row_number().over(latest)).where("_version = 1").drop("_version")


def drop_deleted(ev: DataFrame, key: tuple[str, ...] = VERSION_KEY) -> DataFrame:
    """Rows whose winning version is a deletion vanish."""
    return dedup(ev, key).where("is_deleted = 0")


def upsert_by_id(new: DataFrame, existing: DataFrame | None = None, key: Sequence[str] = ID_KEY) -> DataFrame:
    """Create-once: the first row per id, and none for an id that is already there."""
    first = Window.partitionBy(*key).orderBy("arrived_at", "event_timestamp")
    created = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return created if existing is None else created.join(existing.select(*key), list(key), "left_anti")


# -- requests --------------------------------------------------------------


def check_scope(events: DataFrame, request: str = "request_id", pos: str = "pos") -> DataFrame:
    """Adds `rejected_at`: the first event of the request that is for another org or workspace.

    Only requests with a mismatch are aggregated and joined back, so sound traffic is not grouped.
    """
    differs = ~F.col("org_id").eqNullSafe(F.col("request_org")) | ~F.col("workspace_id").eqNullSafe(
        F.col("request_workspace")
    )
    bad = events.where(differs).groupBy(request).agg(F.min(pos).alias("rejected_at"))
    return events.join(bad, request, "left")


def allow_events(df: DataFrame, allow: DataFrame, name: str = "event_name") -> DataFrame:
    """Adds `allowed`: in the configured set of the row's org and workspace, or no set is configured.

    ``allow`` is configuration: (org_id, workspace_id, event_name).
    """
    sets = allow.groupBy("org_id", "workspace_id").agg(F.collect_set("event_name").alias("_names"))
    sets = F.broadcast(sets) if fits_broadcast(allow) else sets
    joined = df.join(sets, ["org_id", "workspace_id"], "left")
    allowed = F.col("_names").isNull() | F.array_contains("_names", F.col(name))
    return joined.select(*[df[c] for c in df.columns], allowed.alias("allowed"))


def collection_status(df: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request: how many events were filtered out, collected and sent."""
    return df.groupBy(request).agg(
        F.count_if(~F.col("allowed")).alias("filtered"),
        F.count_if("allowed").alias("collected"),
        F.count(F.lit(1)).alias("total"),
    )


def with_authenticated(df: DataFrame, flag: Column | bool) -> DataFrame:
    return df.withColumn("authenticated", flag if isinstance(flag, Column) else F.lit(flag))


# -- enrichment ------------------------------------------------------------


def enrich_arrived_at(
    df: DataFrame, now: datetime | str | None = None, enabled: bool = True, override_existing: bool = False
) -> DataFrame:
    """On by default: the arrival time is set unless present, or always when overriding."""
    if not enabled:
        return df
    stamp = F.current_timestamp() if now is None else times.time_lit(now)
    return df.withColumn("arrived_at", stamp if override_existing else F.coalesce("arrived_at", stamp))


def enrich_ip(df: DataFrame, request_ip: str, override_existing: bool = False) -> DataFrame:
    """Copies the request's address into the event unless it has one, or always when overriding."""
    sent, own = F.col(request_ip), F.col("ip_address")
    return df.withColumn("ip_address", F.coalesce(sent, own) if override_existing else F.coalesce(own, sent))


_SALTS = 16


def enrich_country(df: DataFrame, ranges: DataFrame, ip: str, override_existing: bool = False) -> DataFrame:
    """Country of a public address of either family from non-overlapping ranges (lo, hi, range_country).

    ``lo`` and ``hi`` are addresses as text, or numbers for IPv4. The range condition becomes an equality on the leading bits
    plus a residual. A range table of checked size is broadcast; a larger one is shuffled, both sides salted because one
    bucket may hold a large share of the events. Rows that need no lookup are not part of that shuffle.
    """
    numeric = isinstance(ranges.schema["lo"].dataType, T.NumericType)
    key = number_key if numeric else address_key
    table = ranges.select(key(F.col("lo")).alias("_lo"), key(F.col("hi")).alias("_hi"), "range_country")
    table = table.withColumn("_bucket", F.explode(F.sequence(key_bucket(F.col("_lo")), key_bucket(F.col("_hi")))))
    wanted = is_public_ip(F.col(ip)) if override_existing else F.col("country").isNull() & is_public_ip(F.col(ip))
    keyed = df.withColumn("_key", F.when(wanted, address_key(F.col(ip)))).withColumn("_bucket", key_bucket(F.col("_key")))

    def found(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        left, right = rows.alias("e"), table.alias("r")
        match = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in on] + [F.col("e._key").between(F.col("r._lo"), F.col("r._hi"))]
        country = F.coalesce(F.col("r.range_country"), F.col("e.country"))
        joined = left.join(right, match, "left")
        return joined.select(*[country.alias(c) if c == "country" else F.col(f"e.{c}") for c in df.columns])

    if fits_broadcast(table):
        return found(keyed, F.broadcast(table), ["_bucket"])
    asked = keyed.where("_key is not null").withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(_SALTS)))
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<bigint>")))
    return found(asked, salted, ["_bucket", "_salt"]).unionByName(keyed.where("_key is null").select(*df.columns))


# -- archive routing -------------------------------------------------------

# Why a payload cannot be routed, in order of precedence.
QUARANTINE_REASONS = ("InvalidJson", "MissingOrgId", "MissingTimestamp")


def classify_archive(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds org, workspace, dt, hour — or the reason the payload goes to quarantine."""
    opened = documents.fields_of(documents.whole_json(F.col(value)))
    parsed = raw.withColumn("_fields", documents.fence(opened))
    fields = F.col("_fields")
    at = lambda name: times.rfc3339(documents.field_text(fields, name))
    # A routing field of another type makes the payload unreadable, like broken JSON.
    used = ("org_id", "workspace_id", "arrived_at", "occured_at")
    typed = [documents.is_kind(documents.field(fields, name), "STRING") for name in used]
    readable = fields.isNotNull() & typed[0] & typed[1] & typed[2] & typed[3]
    rows = parsed.withColumns(
        {
            "_readable": F.coalesce(readable, F.lit(False)),
            "_org": F.nullif(documents.field_text(fields, "org_id"), F.lit("")),
            "_workspace": F.coalesce(F.nullif(documents.field_text(fields, "workspace_id"), F.lit("")), F.lit("default")),
            "_at": F.coalesce(at("arrived_at"), at("occured_at")),
        }
    )
    invalid, no_org, no_time = (F.lit(reason) for reason in QUARANTINE_REASONS)
    reason = (
        F.when(~F.col("_readable"), invalid).when(F.col("_org").isNull(), no_org).when(F.col("_at").isNull(), no_time)
    )
    routed = lambda column, name: F.when(F.col("reason").isNull(), column).alias(name)
    return rows.withColumn("reason", documents.fence(reason)).select(
        *raw.columns,
        "reason",
        routed(F.col("_org"), "org"),
        routed(F.col("_workspace"), "workspace"),
        routed(F.date_format("_at", "yyyy-MM-dd"), "dt"),
        routed(F.hour("_at"), "hour"),
    )


# -- search destinations ---------------------------------------------------


def resolve_setting(
    df: DataFrame, overrides: DataFrame, default: str, pinned: str | None = None, out: str = "template"
) -> DataFrame:
    """The setting of each row: pinned, else workspace override, else org override, else default.

    ``overrides`` is configuration: (org_id, workspace_id or null, value).
    """
    if pinned is not None:
        return df.withColumn(out, F.lit(pinned))
    by_workspace = overrides.where("workspace_id is not null").select(
        "org_id", "workspace_id", F.col("value").alias("_w")
    )
    by_org = overrides.where("workspace_id is null").select("org_id", F.col("value").alias("_o"))
    if fits_broadcast(overrides):
        by_workspace, by_org = F.broadcast(by_workspace), F.broadcast(by_org)
    joined = df.join(by_workspace, ["org_id", "workspace_id"], "left").join(by_org, "org_id", "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("_w", "_o", F.lit(default)).alias(out))


def route(df: DataFrame, template: str = "template", out: str = "destination") -> DataFrame:
    return df.withColumn(out, names.render(F.col(template), F.col("org_id"), F.col("workspace_id")))


def check_destination(df: DataFrame, template: str = "template") -> DataFrame:
    """Adds `destination`, or the class and reason why the row has none.

    The org is tested before the workspace, so a bad workspace is never blamed on the org.
    """
    pattern, org, workspace = F.col(template), F.col("org_id"), F.col("workspace_id")
    fixed = names.render(pattern, F.lit(""), F.lit(""))
    template_ok = ~fixed.rlike("[{}]") & names.is_index_name(names.render(pattern, F.lit("org"), F.lit("workspace")))
    has_org, has_workspace = pattern.contains("{org_id}"), pattern.contains("{workspace_id}")
    # Names that are looked at more than once are made once, behind a fence.
    made = df.withColumn("_with_org", documents.fence(F.replace(pattern, F.lit("{org_id}"), org)))
    made = made.withColumn("_full", documents.fence(F.replace("_with_org", F.lit("{workspace_id}"), workspace)))
    with_org, full = F.col("_with_org"), F.col("_full")
    # The half-filled name still holds the other placeholder, which is legal in a name.
    bad_org = has_org & ((org == "") | ~names.is_index_name(with_org))
    bad_workspace = has_workspace & ((workspace == "") | ~names.is_index_name(full))
    wrong = F.when(~template_ok, "invalid_index").when(bad_org, "invalid_org").when(bad_workspace, "invalid_workspace")
    checked = made.withColumn("error_class", documents.fence(wrong))
    reason = (
        F.when(F.col("error_class") == "invalid_index", F.lit("the configured template is not a valid name"))
        .when(F.col("error_class") == "invalid_org", F.concat(F.lit("org_id "), org, F.lit(" gives no valid name")))
        .when(
            F.col("error_class") == "invalid_workspace",
            F.concat(F.lit("workspace_id "), workspace, F.lit(" gives no valid name")),
        )
    )
    named = checked.withColumn("error_reason", reason).withColumn("destination", F.when(F.col("error_class").isNull(), full))
    return named.drop("_with_org", "_full")


def check_topic(df: DataFrame, template: str) -> DataFrame:
    """Adds `topic_name` and `topic_ok` for a topic template."""
    rendered = names.render(template, F.col("org_id"), F.col("workspace_id"))
    return df.withColumn("topic_name", rendered).withColumn("topic_ok", names.is_topic_name(F.col("topic_name")))


_ACTION_BYTES = len('{"create":{"_index":"","_id":""}}') + 2


def document_bytes(destination: Column, event_id: Column, value: Column) -> Column:
    """Size of a row as a create request: action line, document line and their line ends."""
    return F.octet_length(destination) + F.octet_length(event_id) + _ACTION_BYTES + F.octet_length(value)


def reject_large(df: DataFrame, max_bytes: int, value: str = "value") -> DataFrame:
    """Adds `too_large` for rows whose create request would exceed ``max_bytes``."""
    size = document_bytes(F.col("destination"), F.col("event_id"), documents.one_line(F.col(value)))
    return df.withColumn("request_bytes", size).withColumn("too_large", F.col("request_bytes") > max_bytes)


# -- properties ------------------------------------------------------------


def with_defaults(df: DataFrame, defaults: Column, properties: str = "properties") -> DataFrame:
    """Default properties below the event's own."""
    return df.withColumn(properties, documents.merge_defaults(F.col(properties), defaults))


# Storefront event -> event name here; any other event is dropped.
STOREFRONT_EVENTS: Mapping[str, str] = {
    "page_viewed": "page_viewed",
    "collection_viewed": "collection_viewed",
    "product_viewed": "product_viewed",
    "search_submitted": "search_submitted",
    "product_added_to_cart": "add_to_cart",
    "product_removed_from_cart": "product_removed_from_cart",
    "cart_viewed": "cart_viewed",
    "checkout_started": "checkout_started",
    "checkout_contact_info_submitted": "checkout_contact_info_submitted",
    "checkout_address_info_submitted": "checkout_address_info_submitted",
    "checkout_shipping_info_submitted": "checkout_shipping_info_submitted",
    "payment_info_submitted": "payment_info_submitted",
    "checkout_completed": "order_completed",
}


def conform_storefront(df: DataFrame, document: str = "document") -> DataFrame:
    """Storefront documents as (event_name, identifiers, context, properties); unmapped names are dropped.

    `identifiers` lists, per kind, the trimmed non-empty values: checkout first, then the signed-in customer.
    """
    doc = F.col(document)
    get = lambda path, kind="string": F.try_variant_get(doc, f"$.{path}", kind)
    truthy = lambda path: F.nullif(get(path), F.lit(""))
    checkout, signed_in = "data.checkout", "init.data.customer"
    found = [
        ("cookie", [get("clientId")]),
        ("email", [get(f"{checkout}.email"), get(f"{signed_in}.email")]),
        (
            "phone",
            [
                F.coalesce(*[truthy(f"{checkout}.{p}") for p in ("phone", "shippingAddress.phone", "billingAddress.phone")]),
                get(f"{signed_in}.phone"),
            ],
        ),
        ("shopify_customer_id", [truthy(f"{checkout}.order.customer.id"), get(f"{signed_in}.id")]),
    ]
    listed = [F.filter(F.transform(F.array(*values), lambda v: F.trim(v)), lambda v: v != "") for _, values in found]
    identifiers = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(kind) for kind, _ in found]), F.array(*listed)), lambda _, v: F.size(v) > 0
    )
    context = F.struct(
        F.lit("browser").alias("source"),
        get("context.document.location.href").alias("page_url"),
        get("context.document.referrer").alias("referrer"),
        get("context.navigator.userAgent").alias("user_agent"),
        get("context.navigator.language").alias("locale"),
    )
    item = lambda li, path, kind="string": F.try_variant_get(li, f"$.{path}", kind)
    items = F.transform(
        get(f"{checkout}.lineItems", "array<variant>"),
        lambda li: F.struct(
            item(li, "variant.sku").alias("sku"),
            item(li, "variant.product.id").alias("product_id"),
            item(li, "variant.id").alias("variant_id"),
            item(li, "quantity", "long").alias("qty"),
            item(li, "variant.price.amount", "double").alias("price"),
        ),
    )
    variant, line = "data.productVariant", "data.cartLine"
    has_line = props.children(get(line, "variant")).isNotNull()
    either = lambda of_line, of_variant: F.when(has_line, get(f"{line}.{of_line}")).otherwise(
        get(f"{variant}.{of_variant}")
    )
    properties = F.struct(
        get("id").alias("shopify_event_id"),
        get("name").alias("shopify_event_name"),
        get("timestamp").alias("shopify_timestamp"),
        get("clientId").alias("shopify_client_id"),
        truthy(f"{checkout}.order.id").alias("order_id"),
        get(f"{checkout}.totalPrice.amount", "double").alias("amount"),
        truthy(f"{checkout}.currencyCode").alias("currency"),
        items.alias("items"),
        either("merchandise.product.id", "product.id").alias("product_id"),
        either("merchandise.id", "id").alias("variant_id"),
        get(f"{variant}.sku").alias("sku"),
        get(f"{variant}.price.amount", "double").alias("price"),
        get(f"{line}.quantity", "long").alias("qty"),
        truthy("data.searchResult.query").alias("query"),
    )
    mapping = F.create_map(*[F.lit(text) for pair in STOREFRONT_EVENTS.items() for text in pair])
    named = df.withColumn("event_name", F.try_element_at(mapping, get("name"))).where("event_name is not null")
    return named.select(
        "event_name",
        identifiers.alias("identifiers"),
        context.alias("context"),
        # Null members are not written, so absent properties stay absent.
        F.parse_json(F.to_json(properties)).alias("properties"),
    )


def has_nested(properties: Column) -> Column:
    return props.has_nested(properties)
