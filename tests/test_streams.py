"""Streams: exactly once per event id in effect, late events kept, interrupted runs resumed."""

import hashlib
import json
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest
from data import log_of, payload
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.model import Scope
from tidemark.operators import ingest
from tidemark.sources import events as sources
from tidemark.streaming import archive, batches, cycles, jobs, sinks

START = datetime(2026, 9, 1, tzinfo=timezone.utc)


def stamp(at):
    return at.isoformat().replace("+00:00", "Z")


@pytest.fixture
def log(spark, folder):
    """2,000 records in 8 files: events up to 30 days late in any order, a resend in twenty, one bad org in a hundred."""
    rng = random.Random(7)
    values = []
    for n in range(1_900):
        org = "Bad Org" if n % 100 == 50 else "org-one"
        at = START - timedelta(minutes=rng.randrange(43_200))
        values.append(payload(n, org_id=org, occured_at=stamp(at), arrived_at=stamp(START + timedelta(seconds=n)), workspace_id=f"workspace-{n % 2}"))
    again = rng.sample(range(1_900), 100)
    for n in again:
        values.insert(rng.randrange(len(values)), values[n])
    for part in range(8):
        log_of(spark, values[part * 250 : (part + 1) * 250], partition=part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return f"{folder}/log"


def test_every_record_has_one_outcome(spark, folder, log):
    stream = sources.read_event_stream(spark, log, files_per_trigger=2)
    jobs.start_ingest(stream, folder, f"{folder}/cp").awaitTermination()
    facts = sources.facts(spark, f"{folder}/facts")
    letters = spark.read.parquet(f"{folder}/dead_letters")
    prepared = jobs.prepare(spark.read.parquet(log))
    sent = prepared.select("topic", "partition", "offset", "org_id", "workspace_id", F.when(F.col("error_class").isNull(), F.col("event_id")).alias("event_id"))
    audit = sinks.dedup_audit(sent, facts, letters).first().asDict()
    bad = prepared.where("error_class is not null").count()
    assert (audit["missing_ids"], audit["duplicated_ids"], audit["unexpected_ids"]) == (0, 0, 0)
    assert audit["valid_ids"] == audit["written_rows"] == 1_881 and audit["bad_records"] == audit["dead_letters"] == bad
    archived = sources.read_archive(spark, f"{folder}/archive", once=False)
    assert archived.count() == 2_000
    assert sources.read_archive(spark, f"{folder}/archive").count() == 1_900
    one = sources.facts(spark, f"{folder}/facts", Scope("org-one", "workspace-1"), ("2026-08-05", "2026-08-20"))
    assert {r[0] for r in one.select("workspace_id").distinct().collect()} == {"workspace-1"}


def test_a_repeated_batch_replaces_itself(spark, folder, log):
    batch = ingest.conform(ingest.decode(spark.read.parquet(log)).where("error_class is null"))
    for _ in range(2):
        sinks.write_facts(batch, f"{folder}/facts", 3)
        sinks.write_catalog(batch, f"{folder}/catalog", 3)
    assert sources.facts(spark, f"{folder}/facts", raw=True).count() == batch.count()
    assert sinks.merge_facts(spark, f"{folder}/facts") == 1 and sinks.merge_facts(spark, f"{folder}/facts") == 0
    assert sources.facts(spark, f"{folder}/facts", raw=True).count() == 1_900


def test_merged_and_fresh_rows_read_as_one(spark, folder):
    root = f"{folder}/facts"
    rows = lambda numbers, **more: ingest.conform(ingest.decode(log_of(spark, [payload(n, occured_at=f"2026-{1 + n % 3:02d}-01T00:00:00Z") for n in numbers]))).withColumns({k: F.lit(v) for k, v in more.items()})
    later, dead = datetime(2030, 1, 1), F.lit(1).cast("byte")
    sinks.write_facts(rows(range(30)), root, 0)
    sinks.write_facts(rows(range(10)), root, 1)
    assert sinks.merge_facts(spark, root) == 2
    plan = sources.facts(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # resolved once, when it was merged
    sinks.write_facts(rows([0, 3, 6]).withColumn("is_deleted", dead).withColumn("updated_at", F.lit(later)), root, 2)
    sinks.write_facts(rows([90]), root, 3)
    seen = lambda: sources.facts(spark, root).select("event_id").distinct().count()
    assert sources.facts(spark, root).count() == seen() == 28
    assert sources.facts(spark, root, Scope("org-one", "workspace-a"), ("2026-02-01", "2026-02-28")).count() == 10
    assert sinks.merge_facts(spark, root) == 2 and sources.facts(spark, root).count() == 28
    sinks.write_facts(rows([3]), root, 4)  # an old version comes late
    assert sources.facts(spark, root).count() == 28
    assert sources.batch_ids(spark, root) == [4]


def test_a_failed_batch_is_run_again(spark, folder, log):
    stream, seen = sources.read_event_stream(spark, log, files_per_trigger=2), []

    def write(batch, batch_id):
        seen.append(batch_id)
        sinks.write_facts(ingest.conform(ingest.decode(batch).where("error_class is null")), f"{folder}/facts", batch_id)
        if seen == [0, 1]:
            raise RuntimeError("lost after writing, before the offsets moved")

    first = jobs.foreach_batch_once(stream, write, f"{folder}/cp")
    with pytest.raises(Exception, match="lost after writing"):
        first.awaitTermination()
    jobs.foreach_batch_once(stream, write, f"{folder}/cp").awaitTermination()
    assert seen[:3] == [0, 1, 1]
    assert sources.facts(spark, f"{folder}/facts", raw=True).count() == 2_000
    assert sources.facts(spark, f"{folder}/facts").count() == 1_900


def test_stream_dedup_loses_nothing(spark, folder, log):
    stream = sources.read_event_stream(spark, log, files_per_trigger=1)
    events = ingest.conform(ingest.decode(stream).where("error_class is null")).select(*ingest.ID_KEY, "event_timestamp", "arrived_at")
    query = jobs.start_deduped(events, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    assert len(query.recentProgress) >= 8 and rows.count() == rows.select("event_id").distinct().count() == 1_900


def test_stream_dedup_keeps_first_arrivals_of_any_age(spark, folder):
    """Batches whose arrival goes back in time, a copy long after any delay, and two orgs that share ids."""
    for part, (day, org) in enumerate([(20, "org-one"), (25, "org-one"), (1, "org-one"), (20, "org-two"), (30, "org-one")]):
        numbers = range(10) if part in (0, 3, 4) else range(10 * part, 10 * part + 10)
        values = [payload(n, org_id=org, arrived_at=f"2026-09-{day:02d}T00:00:00Z") for n in numbers]
        log_of(spark, values, partition=part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = sources.read_event_stream(spark, f"{folder}/log", files_per_trigger=1)
    events = ingest.conform(ingest.decode(stream).where("error_class is null"))
    jobs.start_deduped(events.select(*ingest.ID_KEY, "event_timestamp", "arrived_at"), f"{folder}/out", f"{folder}/cp").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    assert {r["org_id"]: r["count"] for r in rows.groupBy("org_id").count().collect()} == {"org-one": 30, "org-two": 10}


def test_a_copy_with_another_event_month_is_dropped(spark, folder):
    for part, month in enumerate([3, 1, 9, 2]):  # out of order; each file is a batch and brings ten new ids and all earlier ones again
        values = [payload(n, occured_at=f"2026-{month:02d}-{1 + part:02d}T00:00:00Z") for n in range(10 * part + 10)]
        log_of(spark, values, partition=part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = sources.read_event_stream(spark, f"{folder}/log", files_per_trigger=1)
    events = ingest.conform(ingest.decode(stream).where("error_class is null")).select(*ingest.ID_KEY, "event_timestamp", "arrived_at")
    for run in range(2):  # a later start goes on with the state of the first
        query = jobs.start_deduped(events, f"{folder}/out", f"{folder}/cp")
        query.awaitTermination()
        rows = spark.read.parquet(f"{folder}/out")
        assert rows.count() == rows.select("event_id").distinct().count() == 40 + run
        log_of(spark, [payload(n) for n in range(41)], partition=9).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def test_orgs_that_share_ids_keep_their_rows(spark, folder):
    rows = ingest.conform(ingest.decode(log_of(spark, [payload(n, org_id=org) for org in ("org-one", "org-two") for n in range(50)])))
    sinks.write_facts(rows, f"{folder}/facts", 0)
    assert sources.facts(spark, f"{folder}/facts").count() == 100
    assert sources.facts(spark, f"{folder}/facts", Scope("org-two", "workspace-a")).count() == 50
    assert ingest.upsert_by_id(rows).count() == 100
    sinks.merge_facts(spark, f"{folder}/facts")
    assert sources.facts(spark, f"{folder}/facts", raw=True).count() == 100


def test_payloads_with_line_breaks_come_back_whole(spark, folder):
    values = [payload(n).replace(", ", ",\n") for n in range(30)]
    archive.write_archive(ingest.classify_archive(log_of(spark, values)), folder)
    assert sorted(r["value"] for r in sources.read_archive(spark, folder).collect()) == sorted(values)


def test_quarantine_holds_a_payload_once(spark, folder):
    classified = ingest.classify_archive(log_of(spark, ["{broken", "{broken", "{other"]))
    for batch_id in (0, 1, 1):
        sinks.write_quarantine(classified, folder, batch_id)
    assert sorted(r["value"] for r in spark.read.parquet(f"{folder}/_quarantine").collect()) == ["{broken", "{other"]


def test_live_histogram_and_order_on_read(spark, folder, log):
    stream = sources.read_event_stream(spark, log, files_per_trigger=2)
    events = ingest.conform(ingest.decode(stream).where("error_class is null")).select("event_timestamp")
    jobs.start_histogram(events, "1d", f"{folder}/h", f"{folder}/cp").awaitTermination()
    live = {r["time"]: r["count"] for r in jobs.read_histogram(spark, f"{folder}/h").collect()}
    rows = ingest.conform(ingest.decode(spark.read.parquet(log)).where("error_class is null"))
    day = F.date_trunc("day", "event_timestamp")
    assert live == {r[0]: r[1] for r in rows.groupBy(day).count().collect()}


def test_archive_keeps_bytes_and_order(spark, folder):
    values = [payload(n, note="é \\\" , ;") for n in range(40)] + ["{broken"]
    log_of(spark, values).write.parquet(f"{folder}/log")
    jobs.start_archive(sources.read_event_stream(spark, f"{folder}/log"), f"{folder}/a", f"{folder}/cp", seconds=None).awaitTermination()
    rows = sources.read_archive(spark, f"{folder}/a", Scope("org-one", "workspace-a"), ("2026-09-01", "2026-09-01"), once=False)
    assert [r["value"] for r in rows.collect()] == values[:-1]
    quarantined = spark.read.parquet(f"{folder}/a/_quarantine").collect()
    assert [(r["reason"], r["value"]) for r in quarantined] == [("InvalidJson", "{broken")]


def published(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_archive_objects_are_named_by_content_and_written_once(spark, folder):
    rows = ingest.classify_archive(log_of(spark, [payload(n, note="x\ny") for n in range(25)] + ["{broken"]))
    archive.write_archive(rows, folder, max_rows=10, source="test", created_at="2026-09-02T00:00:00Z")
    first = published(folder)
    archive.write_archive(rows.repartition(7), folder, max_rows=10, source="again", created_at="2027-01-01T00:00:00Z")
    assert published(folder) == first and len(first) == 6  # three objects, three manifests, nothing staged
    listed = archive.read_manifests(spark, folder).orderBy("ranges").collect()
    assert [(r["event_count"], r["ranges"], r["source"]) for r in listed] == [(10, "events:0:0:9", "test"), (10, "events:0:10:19", "test"), (5, "events:0:20:24", "test")]
    body = "".join(f"{payload(n, note='x' + chr(10) + 'y')}\n" for n in range(10))
    assert listed[0]["content_hash"] == hashlib.sha256(body.encode()).hexdigest()[:16]
    assert archive.folder_manifests(archive.read_manifests(spark, folder)).first()["ranges"] == "events:0:0:24"


def test_an_aborted_archive_batch_leaves_nothing_visible(spark, folder):
    rows = ingest.classify_archive(log_of(spark, [payload(n) for n in range(30)]))
    failing = rows.withColumn("value", F.when(F.col("offset") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        archive.write_archive(failing, folder, max_rows=10)
    assert published(folder) == [] and sources.read_archive(spark, folder, once=False).count() == 0
    archive.write_archive(rows, folder, max_rows=10)
    assert sources.read_archive(spark, folder, once=False).count() == 30


def test_a_batch_published_in_part_is_finished(spark, folder):
    rows = ingest.classify_archive(log_of(spark, [payload(n) for n in range(30)]))
    archive.write_archive(rows, folder, max_rows=10)
    whole = published(folder)
    gone = next(Path(folder) / name for name in whole if name.endswith(".gz"))
    gone.unlink()
    archive.write_archive(rows, folder, max_rows=10)
    assert published(folder) == whole and sources.read_archive(spark, folder, once=False).count() == 30


def test_cycles_carry_their_surplus(spark, folder):
    add = lambda numbers: log_of(spark, [f"v{n}" for n in numbers]).withColumn("offset", F.col("offset") + min(numbers)).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    add(range(250))
    query = cycles.start_cycles(sources.read_event_stream(spark, f"{folder}/log"), 100, 20, f"{folder}/out", f"{folder}/cp", 0.5)
    try:
        cycles.await_records(query, f"{folder}/out", 200, 120)
        add(range(250, 320))  # with the 50 that wait: one cycle, and 20 that wait on
        cycles.await_records(query, f"{folder}/out", 300, 120)
        sizes = lambda: sorted((r["cycle"], r["by"], r["count"]) for r in cycles.read_cycles(spark, f"{folder}/out").groupBy("cycle", "by").count().collect())
        assert sizes() == [(0, "number", 100), (1, "number", 100), (2, "number", 100)]
        cycles.await_records(query, f"{folder}/out", 320, 120)
        assert sizes()[3:] == [(3, "time", 20)]  # and windows without records fire nothing
    finally:
        query.stop()
    rows = cycles.read_cycles(spark, f"{folder}/out").orderBy("offset").collect()
    assert [(r["offset"], r["cycle"]) for r in rows] == [(n, n // 100) for n in range(320)]


def test_linger_batches_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("t" if n % 3 else "u", n % 2, n, rng.choice([10, 200, 900, 5000])) for n in range(3_000)]
    found = batches.linger_batches(spark.createDataFrame(rows, "topic string, partition int, offset long, size int").repartition(5), 7, 2_000)
    expected, state = [], {}
    for topic, partition, offset, size in rows:
        batch, docs, held = state.get((topic, partition), (0, 0, 0))
        if docs and (docs >= 7 or held + size > 2_000):
            batch, docs, held = batch + 1, 0, 0
        state[topic, partition] = (batch, docs + 1, held + size)
        expected.append((topic, partition, offset, size, batch))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert batches.linger_batches(spark.createDataFrame([], "topic string, partition int, offset long, size int")).count() == 0


def test_archive_folders_expire(spark, folder):
    for day in ("2026-08-01", "2026-08-30"):
        rows = ingest.classify_archive(log_of(spark, [payload(occured_at=f"{day}T00:00:00Z")]))
        archive.write_archive(rows, folder)
    dropped = sinks.expire_folders(spark, folder, "2026-09-01")
    assert len(dropped) == 1 and dropped[0].endswith("dt=2026-08-01")
    assert [r["dt"] for r in sources.read_archive(spark, folder).collect()] == ["2026-08-30"]


def test_topic_options():
    assert sources.topic_options("b:1", ["a", "b"])["subscribe"] == "a,b"
    assert sources.topic_options("b:1", ["^events\\..*", "a.b"])["subscribePattern"] == r"(^events\..*)|(^a\.b$)"


def test_missing_table_is_empty(spark, folder):
    assert sources.facts(spark, f"{folder}/none").count() == 0


def test_counters_read_the_log_once(spark, log):
    prepared = jobs.prepare(spark.read.parquet(log))
    counted = sinks.ingest_counters(prepared)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 1
    found = {(r["counter"], r["label"]): r["count"] for r in counted.collect()}
    rejected = prepared.where("error_class is not null").count()
    ids = prepared.where("error_class is null").select(*ingest.ID_KEY).distinct().count()
    wanted = {("consumed", "events"): 2000, ("written", "created"): ids, ("written", "already_written"): 2000 - rejected - ids, ("rejected", "invalid_org"): rejected}
    assert found == wanted
    none = sinks.ingest_counters(prepared.where("false")).collect()
    assert sorted((r["counter"], r["label"], r["count"]) for r in none) == [("written", "already_written", None), ("written", "created", None)]


def test_counters_know_the_ids_that_are_there(spark):
    prepared = jobs.prepare(log_of(spark, [payload(1), payload(1), payload(2), payload(3), "oops"]))
    there = prepared.where("offset = 2").select(*ingest.ID_KEY)
    found = {(r["counter"], r["label"]): r["count"] for r in sinks.ingest_counters(prepared, there.union(there)).collect()}
    assert found == {("consumed", "events"): 5, ("written", "created"): 2, ("written", "already_written"): 2, ("rejected", "decode"): 1}


def test_audit_parses_the_log_once(spark):
    """The query looks at what became of the records five times; the log is parsed for none of them."""
    plan = entry.queries()["dedup_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "props#" not in plan


def test_a_long_partition_is_sorted_in_runs(monkeypatch):
    """Only as many rows as fit a run are held; the order is that of one sort, copies and nulls among them."""
    monkeypatch.setattr(cycles, "RUN_BYTES", 2_000)
    monkeypatch.setattr(cycles, "RUN_ROWS", 3)
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.choice([None, "", "ü", "v" * rng.randrange(60)])) for _ in range(1_000)]
    parts = (pd.DataFrame(rows[start : start + 10], columns=["offset", "value"]) for start in range(0, 1_000, 10))
    found = list(cycles.in_order(parts))
    assert found == sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or ""))
    assert list(cycles.in_order(iter([]))) == []


def test_the_archive_commit_only_lists_and_publishing_twice_moves_once(folder):
    row = {"org": "o", "workspace": "w", "dt": "2026-09-01", "hour": 1, "topic": "t", "partition": 0, "block": 0, "offset": 5, "value": "{}"}
    writer = archive.ArchiveWriter({"path": f"file://{folder}", "stage": "_staging/s"})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([row])]))])
    assert all(name.startswith("_staging/") for name in published(folder))  # the driver has moved no object
    listed = [json.loads(line) for file in Path(folder).glob("_staging/s/lists/*") for line in file.read_text().splitlines()]
    run = archive._publisher(f"file://{folder}")
    moved = [next(run(iter([pa.RecordBatch.from_pylist(listed)]))).column(0).to_pylist() for _ in range(2)]
    assert moved == [[1], [0]]
    assert len([n for n in published(folder) if n.startswith(("org=", "_manifests/"))]) == 2
