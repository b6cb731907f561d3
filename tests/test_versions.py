"""The fact table's published versions: size-tiered merging, readers during a merge, merges that end early."""

import os
from datetime import datetime

import pytest
from data import log_of, payload
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources import events, versions
from tidemark.sources.versions import Manifest, Run, Versions
from tidemark.streaming import jobs, sinks


def rows_of(spark, numbers, **more):
    values = [payload(n, occured_at=f"2026-{1 + n % 3:02d}-01T00:00:00Z") for n in numbers]
    return ingest.conform(ingest.decode(log_of(spark, values))).withColumns({k: F.lit(v) for k, v in more.items()})


def folders(root):
    return [n for n in os.listdir(root) if n.startswith("batch_id=")], os.listdir(f"{root}/_runs") if os.path.exists(f"{root}/_runs") else []


def test_runs_are_merged_by_size():
    runs, rewritten, number = [], 0, 0
    for _ in range(5_000):
        size = 20 << 20
        joining = sinks._joining(runs, size)
        size += sum(r.size for r in joining)
        rewritten += size
        runs = [r for r in runs if r not in joining] + [Run(str(number), size)]
        number += 1
        assert len(runs) <= 8 * 6
    assert sum(r.size for r in runs) == 5_000 * (20 << 20)
    assert rewritten <= 6 * 5_000 * (20 << 20)  # about once per size class


def test_scheduled_merging_bounds_the_folders(spark, folder):
    root = f"{folder}/facts"
    for batch in range(24):
        sinks.write_facts(rows_of(spark, [batch, batch + 1]), root, batch)
        sinks.keep_merged(spark, root, 4)
        batches, runs = folders(root)
        assert len(batches) <= 4 * (sinks.KEEP + 1) and len(runs) <= sinks.FANOUT * (sinks.KEEP + 1)
    assert sorted(r[0] for r in events.facts(spark, root).groupBy("event_id").count().select("count").collect()) == [1] * 25
    assert len(os.listdir(f"{root}/_versions")) <= 2 * sinks.KEEP  # and their checksums


def test_a_reader_keeps_its_version_during_merges(spark, folder):
    root = f"{folder}/facts"
    sinks.write_facts(rows_of(spark, range(20)), root, 0)
    sinks.merge_facts(spark, root)
    sinks.write_facts(rows_of(spark, range(10, 30)), root, 1)
    before = events.facts(spark, root)  # planned now, read after the merges
    sinks.merge_facts(spark, root)
    sinks.write_facts(rows_of(spark, [50]), root, 2)
    sinks.merge_facts(spark, root)
    assert before.count() == 30 and events.facts(spark, root).count() == 31


def test_a_merge_that_ends_early_changes_nothing(spark, folder, monkeypatch):
    root = f"{folder}/facts"
    sinks.write_facts(rows_of(spark, range(20)), root, 0)
    lost = lambda *_: (_ for _ in ()).throw(RuntimeError("lost before it was published"))
    with monkeypatch.context() as patched:
        patched.setattr(Versions, "publish", lost)
        with pytest.raises(RuntimeError):
            sinks.merge_facts(spark, root)
    assert len(folders(root)[1]) == 1 and events.batch_ids(spark, root) == [0] and events.facts(spark, root).count() == 20
    assert sinks.merge_facts(spark, root) == 1 and events.facts(spark, root, raw=True).count() == 20
    assert len(folders(root)[1]) == 1  # the unpublished folder is gone


def test_one_of_two_merges_is_published(spark, folder, monkeypatch):
    root = f"{folder}/facts"
    sinks.write_facts(rows_of(spark, range(20)), root, 0)
    own, size = versions.Versions(spark, root), Versions.size

    def other_first(self, name):
        if name.startswith("_runs"):
            assert own.publish(Manifest(1))
        return size(self, name)

    monkeypatch.setattr(Versions, "size", other_first)
    assert sinks.merge_facts(spark, root) == 0
    assert own.current() == Manifest(1) and events.facts(spark, root).count() == 20


def test_a_batch_written_again_is_read_again(spark, folder):
    root, later = f"{folder}/facts", datetime(2030, 1, 1)
    sinks.write_facts(rows_of(spark, range(20)), root, 0)
    sinks.merge_facts(spark, root)
    sinks.write_facts(rows_of(spark, [0], updated_at=later, country="FR"), root, 0)  # another run of the job, with ids from 0
    assert events.batch_ids(spark, root) == [0]
    assert events.facts(spark, root).where("country = 'FR'").count() == 1 and events.facts(spark, root).count() == 20
    for _ in range(3):
        sinks.merge_facts(spark, root, keep=0)
        assert events.facts(spark, root).count() == 20
    assert folders(root)[0] == []


def test_empty_and_unfinished_batches(spark, folder):
    root = f"{folder}/facts"
    assert sinks.merge_facts(spark, root) == 0 and events.facts(spark, root).count() == 0
    sinks.write_facts(rows_of(spark, [1]).where("false"), root, 0)
    assert sinks.merge_facts(spark, root) == 1 and events.facts(spark, root).count() == 0
    sinks.write_facts(rows_of(spark, range(5)), root, 1)
    os.remove(f"{root}/batch_id=1/_SUCCESS")  # still being written
    assert events.facts(spark, root).count() == 0 and sinks.merge_facts(spark, root) == 0


def test_ingest_merges_as_it_goes(spark, folder):
    log_of(spark, [payload(n % 40) for n in range(90)]).repartition(9).write.parquet(f"{folder}/log")
    stream = events.read_event_stream(spark, f"{folder}/log", files_per_trigger=1)
    jobs.start_fact_sink(stream, f"{folder}/facts", f"{folder}/cp").awaitTermination()
    assert Versions(spark, f"{folder}/facts").current().version >= 1
    assert events.facts(spark, f"{folder}/facts").count() == 40
