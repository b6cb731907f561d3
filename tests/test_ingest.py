"""Decoding, enrichment, routing, versions and dead letters."""

import json

import pytest
from data import facts_of, log_of, payload
from pyspark.sql import functions as F

from tidemark.functions import addresses
from tidemark.operators import catalog, ingest, metrics
from tidemark.sources import events as sources
from tidemark.streaming import jobs, sinks


def problems(spark, values):
    rows = ingest.decode(log_of(spark, values)).orderBy("offset").collect()
    return [(r["error_reason"] or "").removeprefix("not a canonical event: ") for r in rows]


def test_decode(spark):
    sound = [payload(), payload(extra=1, properties=[1]), payload(arrived_at="2026-09-01T10:00:00.123456789Z", authenticated=None),
             payload(system_properties=None), payload(system_properties={"geo": None}), payload(session_id=None)]
    assert problems(spark, sound) == [""] * len(sound)
    required = ["envelop_version", "id", "name", "occured_at", "org_id", "workspace_id", "anon_id"]
    assert problems(spark, [payload(drop=[f]) for f in required]) == required
    wrong = {"envelop_version": "2.0", "id": "x", "name": 5, "occured_at": "today", "arrived_at": "x", "org_id": None, "session_id": 1,
             "authenticated": "yes", "system_properties": 5}
    assert problems(spark, [payload(**{f: v}) for f, v in wrong.items()]) == list(wrong)
    nested = [{"geo": 1}, {"geo": {"country": 1}}, {"timezone": 1}, {"ip_address": []}]
    assert problems(spark, [payload(system_properties=v) for v in nested]) == [
        "system_properties.geo", "system_properties.geo.country", "system_properties.timezone", "system_properties.ip_address"]
    assert problems(spark, ["", None, "oops", payload() + "x", "[]"]) == ["empty payload", "empty payload", "object", "object", "object"]


def test_conform(spark):
    full = payload(arrived_at="2026-09-01T10:00:01.999999999Z", occured_at="2026-09-01T12:00:00.1234+02:00", properties={"amount": 12.5},
                   system_properties={"geo": {"country": "DE"}, "timezone": "Europe/Berlin", "ip_address": "1.1.1.1"})
    long_country = payload(1, system_properties={"geo": {"country": "DEU"}})
    one, two = ingest.conform(ingest.decode(log_of(spark, [full, long_country]))).orderBy(F.col("country").desc_nulls_last()).collect()
    assert (one["country"], one["timezone"], one["ip_address"], two["country"], two["timezone"]) == ("DE", "Europe/Berlin", "1.1.1.1", None, None)
    assert one["event_timestamp"].isoformat() == "2026-09-01T10:00:00.123000" and one["arrived_at"].microsecond == 999_000
    assert (two["actor_id"], two["session_id"], two["arrived_at"], two["authenticated"], two["is_deleted"]) == ("", "", None, None, 0)


@pytest.mark.parametrize(
    ("event", "want"),
    [
        (payload(arrived_at="2026-09-01T23:59:59Z"), (None, "org-one", "workspace-a", "2026-09-01", 23)),
        (payload(arrived_at="2026-09-02T01:30:00+05:30"), (None, "org-one", "workspace-a", "2026-09-01", 20)),
        (payload(arrived_at="garbage"), (None, "org-one", "workspace-a", "2026-09-01", 10)),
        (payload(drop=["workspace_id"]), (None, "org-one", "default", "2026-09-01", 10)),
        (payload(workspace_id=""), (None, "org-one", "default", "2026-09-01", 10)),
        ("{broken", ("InvalidJson", None, None, None, None)),
        (payload(org_id=5), ("InvalidJson", None, None, None, None)),
        (payload(drop=["org_id", "occured_at"]), ("MissingOrgId", None, None, None, None)),
        (payload(org_id=""), ("MissingOrgId", None, None, None, None)),
        (payload(drop=["occured_at"]), ("MissingTimestamp", None, None, None, None)),
    ],
)
def test_archive_routing(spark, event, want):
    row = ingest.classify_archive(log_of(spark, [event])).first()
    assert (row["reason"], row["org"], row["workspace"], row["dt"], row["hour"]) == want


def test_archive_objects_and_ranges(spark):
    log = log_of(spark, [payload(n) for n in range(5)], "a", 1).unionByName(log_of(spark, [payload(9), "oops", "oops"], "b", 0))
    classified = ingest.classify_archive(log)
    manifest = sinks.archive_manifest(classified, created_at="2026-09-01").first()
    assert (manifest["event_count"], manifest["ranges"]) == (6, "a:1:0:4;b:0:0:0")
    objects = sinks.archive_objects(classified, block=2)
    assert sorted(r["event_count"] for r in objects.collect()) == [1, 1, 2, 2]
    assert sinks.new_objects(objects, objects).count() == 0
    assert sinks.quarantine(classified).count() == 1


def test_batches_replace_system_properties(spark):
    event = json.loads(payload(system_properties={"timezone": "own"}))
    bodies = [{"events": [event, event], "system_properties": {"timezone": "batch"}}, {"events": [event]}, {"events": [event, {"id": 1}]}, {"events": 5}]
    df = spark.createDataFrame([(n, json.dumps(b)) for n, b in enumerate(bodies)], "body_id int, body string")
    rows = sources.explode_batches(df).select("body_id", "pos", F.to_json("document").alias("d")).collect()
    zones = sorted((r["body_id"], r["pos"], (json.loads(r["d"]).get("system_properties") or {}).get("timezone")) for r in rows)
    assert zones == [(0, 0, "batch"), (0, 1, "batch"), (1, 0, None)]


def test_scope_check_and_allow_list(spark):
    rows = [("r1", 0, "o", "w", "a"), ("r1", 1, "o", "x", "b"), ("r1", 2, "o", "y", "a"), ("r2", 0, "o", "w", "b"), ("r2", 1, "o", "w", "c")]
    df = spark.createDataFrame(rows, "request_id string, pos int, org_id string, workspace_id string, event_name string")
    df = df.withColumns({"request_org": F.lit("o"), "request_workspace": F.lit("w")})
    found = {(r["request_id"], r["pos"]): r["rejected_at"] for r in ingest.check_scope(df).collect()}
    assert found == {("r1", 0): 1, ("r1", 1): 1, ("r1", 2): 1, ("r2", 0): None, ("r2", 1): None}
    allow = spark.createDataFrame([("o", "w", "b")], "org_id string, workspace_id string, event_name string")
    status = {r[0]: tuple(r)[1:] for r in ingest.collection_status(ingest.allow_events(df, allow)).collect()}
    assert status == {"r1": (1, 2, 3), "r2": (1, 1, 2)}


def test_enrichment_rules(spark):
    ev = facts_of(spark, [{"arrived_at": None}, {"arrived_at": "2026-01-01T00:00:00Z", "ip_address": "8.8.8.8", "country": "XX"}])
    years = lambda df: sorted(r["arrived_at"].year if r["arrived_at"] else 0 for r in df.collect())
    assert years(ingest.enrich_arrived_at(ev, "2030-01-01")) == [2026, 2030]
    assert years(ingest.enrich_arrived_at(ev, "2030-01-01", override_existing=True)) == [2030, 2030]
    assert years(ingest.enrich_arrived_at(ev, "2030-01-01", enabled=False)) == [0, 2026]
    asked = ev.withColumn("ip", F.lit("9.9.9.9"))
    ips = lambda **o: sorted(r["ip_address"] for r in ingest.enrich_ip(asked, "ip", **o).collect())
    assert ips() == ["8.8.8.8", "9.9.9.9"] and ips(override_existing=True) == ["9.9.9.9"] * 2
    ranges = spark.createDataFrame([(9 * 2**24, 10 * 2**24 - 1, "AA"), (0, 9, "BB")], "lo long, hi long, range_country string")
    countries = lambda ip, **o: sorted(str(r["country"]) for r in ingest.enrich_country(ev.withColumn("ip", F.lit(ip)), ranges, "ip", **o).collect())
    assert countries("9.9.9.9") == ["AA", "XX"] and countries("9.9.9.9", override_existing=True) == ["AA", "AA"]
    assert countries("127.0.0.1") == ["None", "XX"] and countries("nonsense", override_existing=True) == ["None", "XX"]


def test_address_keys(spark):
    import ipaddress

    texts = ["1.2.3.4", "255.255.255.255", "::", "::1", "2A00:1::7:9", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1:0:0:1", "a::", "64:ff9b::8.8.8.8"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    found = {r["ip"]: r["k"] for r in df.select("ip", addresses.address_key(F.col("ip")).alias("k")).collect()}
    number = lambda t: int(ipaddress.ip_address(t)) + (0xFFFF << 32 if "." in t and ":" not in t else 0)
    assert found == {t: f"{number(t):032x}" for t in texts}
    odd = spark.createDataFrame([(t,) for t in ("", "x", "1.2.3", "1::2::3", ":", "12345::", None)], "ip string")
    assert {r[0] for r in odd.select(addresses.address_key(F.col("ip"))).collect()} == {None}


def test_country_join_without_broadcast_is_the_same(spark, monkeypatch):
    rows = [{"source": f"{n % 5}.1.2.{n}"} for n in range(60)] + [{"source": "3.1.2.3"}] * 30 + [{"source": f"2a00:{n % 5}::{n}", "country": "XX" if n % 3 else None} for n in range(40)]
    ev = facts_of(spark, rows)
    blocks = [(f"{n}.0.0.0", f"{n}.255.255.255", f"C{n}") for n in range(4)] + [(f"2a00:{n}::", f"2a00:{n}:ffff:ffff:ffff:ffff:ffff:ffff", f"D{n}") for n in range(4)]
    ranges = spark.createDataFrame(blocks, "lo string, hi string, range_country string")
    run = lambda: sorted((r["source"], r["country"] or "") for r in ingest.enrich_country(ev, ranges, "source").collect())
    small = run()
    assert ("2a00:3::3", "D3") in small and ("2a00:1::1", "XX") in small and ("3.1.2.3", "C3") in small and ("2a00:4::9", "") in small
    monkeypatch.setattr(ingest, "fits_broadcast", lambda *a, **k: False)
    assert run() == small


def test_versions(spark):
    same = {"event_id": "1", "event_timestamp": "2026-09-01T10:00:00Z"}
    rows = [{**same, "updated_at": f"2026-09-01T10:00:0{n}Z", "source": str(n), "is_deleted": int(n == 2)} for n in range(3)]
    rows += [{**same, "event_name": "other"}] * 50
    ev = facts_of(spark, rows)
    assert sorted((r["event_name"], r["source"]) for r in ingest.dedup(ev).collect()) == [("click", "2"), ("other", "")]
    assert [r["event_name"] for r in ingest.drop_deleted(ev).collect()] == ["other"]
    assert ingest.dedup(ingest.dedup(ev)).count() == 2
    assert ingest.upsert_by_id(ev, None).count() == 1 and ingest.upsert_by_id(ev, ev).count() == 0


def test_overrides(spark):
    tenants = [("merchant-9", "x"), ("merchant-1", "x"), ("merchant-2", "eu"), ("merchant-2", "us"), ("broken", "x"), ("", "x"), ("Bad", "x")]
    df = spark.createDataFrame(tenants, "org_id string, workspace_id string")
    config = [("merchant-1", None, "events-merchant-1-dedicated"), ("merchant-2", "eu", "events-merchant-2-eu"), ("broken", None, "Not A Valid Index")]
    overrides = spark.createDataFrame(config, "org_id string, workspace_id string, value string")
    checked = ingest.check_destination(ingest.resolve_setting(df, overrides, "events-{org_id}"))
    got = {(r["org_id"], r["workspace_id"]): r["destination"] or r["error_class"] for r in checked.collect()}
    assert list(got[t] for t in tenants) == [
        "events-merchant-9", "events-merchant-1-dedicated", "events-merchant-2-eu", "events-merchant-2", "invalid_index", "invalid_org", "invalid_org"]
    assert ingest.resolve_setting(df, overrides, "x", pinned="fixed").select("template").distinct().collect()[0][0] == "fixed"
    both = ingest.check_destination(df.withColumn("template", F.lit("e-{org_id}-{workspace_id}")).withColumn("workspace_id", F.lit("A")))
    assert {r["org_id"]: r["error_class"] for r in both.collect()}["merchant-9"] == "invalid_workspace"


def test_dead_letters(spark):
    values = [payload(n, org_id="Bad Org" if n % 10 == 0 else "org-one") for n in range(100)] + ["oops"]
    prepared = jobs.prepare(log_of(spark, values))
    letters = sinks.dead_letters(prepared, "2026-09-01")
    classes = letters.groupBy(F.try_element_at("headers", F.lit("dlq.error.class"))).count().collect()
    assert {r[0]: r[1] for r in classes} == {"invalid_org": 10, "decode": 1}
    assert {r["value"] for r in letters.collect()} == {v for n, v in enumerate(values) if n % 10 == 0}
    assert sinks.unique_letters(letters.unionByName(letters)).count() == 11
    large = jobs.prepare(log_of(spark, [payload(0), payload(1, name="x" * 500)]), max_bytes=500)
    assert [r["error_class"] for r in large.orderBy("offset").collect()] == [None, "too_large"]


def test_shape_changes_are_never_rejected(spark):
    shapes = [{"amount": 5}, {"amount": "5"}, {"amount": {"value": 5}}, {"plan": "premium", "cart": {"coupon": "SAVE10"}}]
    rows = [{"properties": json.dumps(shapes[n % 4]), "event_name": "buy"} for n in range(40)]
    ev = facts_of(spark, rows)
    found = sorted((r["property"], r["type"]) for r in catalog.schema_catalog(ev).collect())
    assert found == [("amount", "Int64"), ("amount", "String"), ("amount.value", "Int64"), ("cart.coupon", "String"), ("plan", "String")]
    assert metrics.property_distribution(ev, "buy", "cart.coupon").first().asDict() == {"property_value": "SAVE10", "count": 10}


def test_catalog_type(spark):
    ev = facts_of(spark, [{"properties": '{"amount":12.5}'}, {"properties": '{"amount":1250.75,"none":null,"empty":{}}'}])
    assert [tuple(r) for r in catalog.schema_catalog(ev).collect()] == [("org-one", "workspace-a", "click", "amount", "Float64")]


def test_rank_zero_is_infinite(spark):
    ev = facts_of(spark, [{"properties": '{"rank":0}'}, {"properties": '{"rank":"4"}'}, {"properties": '{"rank":"x"}'}, {}])
    assert metrics.mean_reciprocal_rank(ev.where("event_id != ''"), "click", "rank").first()[0] == float("inf")
    buckets = {r[0]: r[1] for r in metrics.reciprocal_position(ev, "click", "rank").collect()}
    assert buckets == {"top_2": 1, "top_5": 1}
