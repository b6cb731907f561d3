"""The fact sink over many batches: one look into each document, and batches that more than one task can read."""

import glob
import json
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from data import log_of, payload
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.plans import queries

UUID = "0B0F9C2A-1D3E-4F5A-8B6C-7D8E9F0A1B2C"


def odd_payloads():
    """Sound and unsound events: each field absent, null, of other kinds and in other spellings."""
    values = [None, "", "oops", "null", "[]", "[1,2]", "5", payload(1) + "x", payload(1) + ",1", payload(1) + "]", payload(1) + "\n", '{"a":1,"a":2}']
    sound = json.loads(payload(1, system_properties={"geo": {"country": "DE"}, "timezone": "Europe/Berlin", "ip_address": "1.2.3.4"}))
    fields = [*sound, "arrived_at", "session_id", "actor_id", "source", "correlation_id", "trace_id", "authenticated", "properties"]
    others = ["", "x", 5, 1.5, True, [], {}, None, "2024-01-02T03:04:05Z", "2024-01-02t03:04:05.123456+02:00", "2024-13-02T03:04:05Z", UUID, f"{{{UUID}}}", f"urn:uuid:{UUID}", "1.0"]
    for name in dict.fromkeys(fields):
        values.append(json.dumps({k: v for k, v in sound.items() if k != name}))
        values += [json.dumps(sound | {name: other}) for other in others]
    systems = [{}, {"geo": {}}, {"geo": 1}, {"geo": None}, {"geo": {"country": 5}}, {"geo": {"country": None}}, {"geo": {"country": "DEU"}}, {"geo.country": "FR"}]
    systems += [{"geo": {}, "geo.country": "FR"}, {"geo": {"country": "DE"}, "geo.country": "FR"}, {"geo": {"country": None}, "geo.country": "FR"}, {"geo.country": 5}]
    systems += [{name: other} for name in ("timezone", "ip_address") for other in ("", "x", 5, None, {})]
    return values + [json.dumps(sound | {"system_properties": system}) for system in systems]


def test_one_look_reads_what_two_looks_read(spark):
    log, now = log_of(spark, odd_payloads()), F.lit("2024-03-01").cast("timestamp")
    text = lambda rows: sorted(map(str, rows.withColumn("properties", F.to_json("properties")).collect()))
    once = text(ingest.conform_sound(log, now))
    assert once == text(ingest.conform(ingest.decode(log).where("error_class is null"), now)) and 50 < len(once) < len(odd_payloads())


def test_paths_that_find_nothing_are_not_looked_for(spark):
    """Fields that may be absent are looked up in the opened maps."""
    rows = ingest.conform_sound(log_of(spark, odd_payloads()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "$[" not in plan and "$." not in plan


def test_a_batch_of_one_file_is_spread_over_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "LOG_GROUP", 20_000)
    at = datetime(2024, 1, 1)
    events = [(n, at + timedelta(minutes=n), n % 50, "view" if n % 3 else "click", n * 0.5, f'{{"k": {n % 90}}}') for n in range(12_000)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(queries, "scratch_dir", lambda *_: f"{folder}/scratch")
    found = queries.facts_over_batches(spark, folder).agg(F.sum("event_count")).first()[0]
    # All but the events that are no JSON or have no time; the latter do not count where they are the former.
    assert found == sum(n % 997 != 1 and not (n % 977 == 4 and n % 991 != 2 and n % 983 != 3) for n, *_ in events)
    files = glob.glob(f"{folder}/scratch/log/*.parquet")
    assert len(files) == 19 and all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
