"""Writers for one batch of events. Each owns a folder per batch id, so a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import times
from tidemark.operators.catalog import new_catalog_rows, schema_catalog
from tidemark.operators.ingest import ID_KEY, dedup
from tidemark.sources.events import PART, batch_ids, folder_exists, fresh_rows, run_rows
from tidemark.sources.versions import Manifest, Retired, Run, Versions

ARCHIVE_BLOCK = 10_000
CATALOG_SCHEMA = "org_id string, workspace_id string, event_name string, property string, type string"


def batch_folder(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


def write_facts(facts: DataFrame, root: str, batch_id: int) -> None:
    """Fact rows by org, workspace and month. AQE evens the files out, splitting a large workspace."""
    rows = facts.withColumn("month", F.date_format("event_timestamp", "yyyyMM"))
    rows = rows.hint("rebalance", F.col("org_id"), F.col("workspace_id"), F.col("month"))
    rows.write.mode("overwrite").partitionBy("org_id", "workspace_id", "month").parquet(batch_folder(root, batch_id))


#: Runs of one size class that wait side by side, and batches that wait for a scheduled merge.
FANOUT = 8
#: Bytes up to which runs are of the lowest class; each further class is FANOUT times as large.
SMALLEST = 64 << 20
#: Further versions during which what a merge has replaced stays readable.
KEEP = 2


def _size_class(size: int) -> int:
    level, limit = 0, SMALLEST
    while size > limit:
        level, limit = level + 1, limit * FANOUT
    return level


def _joining(runs: Sequence[Run], size: int) -> list[Run]:
    """The runs that a merge of ``size`` bytes takes along: whole size classes, from the lowest, that the new run would overfill."""
    taken, level = [], 0
    while any(_size_class(run.size) >= level for run in runs):
        peers = [run for run in runs if _size_class(run.size) == level]
        if level >= _size_class(size) and len(peers) + 1 < FANOUT:
            break
        if len(peers) + 1 >= FANOUT:
            taken += peers
            size += sum(run.size for run in peers)
        level += 1
    return taken


def merge_facts(spark: SparkSession, root: str, keep: int = KEEP) -> int:
    """Resolves the batches written since the last merge into a run and publishes it; returns how many batches there were.

    Merging is by size: runs stay as they are until FANOUT of one size class have come together, so a row is rewritten about once per
    class and the number of folders grows with the logarithm of the table. Rows lie by partition (org, workspace, month) and in it by name, time
    and id for range reads. Deletions stay, so an older version that comes late cannot undo them. The new version is published in one step;
    a merge that ends before it has changed nothing, and its folder goes at the next merge. Of two merges at a time one is published; the other fails or returns 0.
    """
    versions = Versions(spark, root)
    manifest = versions.clear(versions.current(), keep)
    batches = versions.fresh(manifest)
    if not batches:
        return 0
    joining = _joining(manifest.runs, sum(versions.size(b.name) for b in batches))
    rows = dedup(run_rows(spark, root, joining).unionByName(fresh_rows(spark, root, batches)))
    order = [*PART, "event_name", "event_timestamp", "event_id"]
    name, number = versions.new_run(manifest), manifest.version + 1
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*PART).parquet(f"{root}/{name}")
    after = Manifest(
        number,
        (*(run for run in manifest.runs if run not in joining), Run(name, versions.size(name))),
        (*manifest.retired, *(Retired(run.name, number) for run in joining), *(Retired(b.name, number, b.written) for b in batches)),
    )
    if not versions.publish(after):
        return 0
    versions.clear(after, keep)
    return len(batches)


def keep_merged(spark: SparkSession, root: str, waiting: int = FANOUT) -> int:
    """The upkeep that ingest jobs run after each batch: merges once ``waiting`` batches have come together."""
    return merge_facts(spark, root) if len(batch_ids(spark, root)) >= waiting else 0


def write_catalog(facts: DataFrame, root: str, batch_id: int) -> None:
    """Catalog rows of this batch that no earlier batch has written."""
    spark, seen = facts.sparkSession, schema_catalog(facts)
    if folder_exists(spark, root):
        earlier = spark.read.schema(CATALOG_SCHEMA + ", batch_id long").parquet(root)
        seen = new_catalog_rows(seen, earlier.where(F.col("batch_id") != batch_id))
    seen.write.mode("overwrite").parquet(batch_folder(root, batch_id))


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    if not folder_exists(spark, root):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return spark.read.schema(CATALOG_SCHEMA + ", batch_id long").parquet(root).drop("batch_id").distinct()


# -- archive ---------------------------------------------------------------

_GROUP = ("org", "workspace", "dt", "hour")


def archive_objects(classified: DataFrame, block: int = ARCHIVE_BLOCK) -> DataFrame:
    """One row per archive object: folder key, content hash, event count and offset range.

    An object holds one block of one partition's offsets, so its body is at most ``block`` payloads.
    The hash is the first 16 hex digits of the body's SHA-256, each payload followed by a line end.
    """
    routed = classified.where("reason is null").withColumn("block", F.floor(F.col("offset") / block))
    bodies = routed.groupBy(*_GROUP, "topic", "partition", "block").agg(
        F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("_rows"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )
    lines = F.transform("_rows", lambda r: F.concat(r["value"], F.lit("\n")))
    hashed = F.substring(F.sha2(F.concat_ws("", lines), 256), 1, 16)
    return bodies.select(*_GROUP, "topic", "partition", "event_count", "first_offset", "last_offset", hashed.alias("content_hash"))


def archive_key(prefix: str | None = None) -> Column:
    """`{prefix}/{org}/{workspace}/dt=…/hour=HH/{hash}.jsonl` of an archive object."""
    parts = F.concat_ws(
        "/",
        F.col("org"),
        F.col("workspace"),
        F.concat(F.lit("dt="), "dt"),
        F.concat(F.lit("hour="), F.lpad(F.col("hour").cast("string"), 2, "0")),
        F.concat(F.col("content_hash"), F.lit(".jsonl")),
    )
    return parts if prefix is None else F.concat(F.lit(f"{prefix}/"), parts)


def new_objects(objects: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects not yet archived: the same content under the same key is written once."""
    key = [*_GROUP, "content_hash"]
    return objects.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def archive_manifest(classified: DataFrame, source: str | None = None, created_at: str | datetime | None = None) -> DataFrame:
    """Per folder: event count, `topic:partition:first:last` ranges and creation time.

    Ranges are listed in the order their first offset was seen.
    """
    ranges = (
        classified.where("reason is null")
        .groupBy(*_GROUP, "topic", "partition")
        .agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    )
    text = F.concat_ws(":", "topic", "partition", "low", "high")
    listed = F.sort_array(F.collect_list(F.struct("low", "topic", "partition", text.alias("text"))))
    created = F.current_timestamp() if created_at is None else times.time_lit(created_at)
    return ranges.groupBy(*_GROUP).agg(
        F.sum("n").alias("event_count"),
        F.concat_ws(";", F.transform(listed, lambda r: r["text"])).alias("ranges"),
        F.lit(source).alias("source"),
        F.first(created).alias("created_at"),
    )


def quarantine(classified: DataFrame) -> DataFrame:
    """Unroutable payloads verbatim, one per distinct content: (content_hash, reason, value)."""
    digest = F.sha2(F.concat("value", F.lit("\n")), 256)
    unique = classified.where("reason is not null").select(digest.alias("digest"), "reason", "value").dropDuplicates(["digest"])
    return unique.select(F.substring("digest", 1, 16).alias("content_hash"), "reason", "value")


def write_quarantine(classified: DataFrame, root: str, batch_id: int) -> None:
    """Quarantined payloads of this batch that no earlier batch holds: a payload is kept once for good."""
    spark, folder, fresh = classified.sparkSession, f"{root}/_quarantine", quarantine(classified)
    if folder_exists(spark, folder):
        earlier = spark.read.schema("content_hash string, reason string, value string, batch_id long").parquet(folder)
        earlier = earlier.where(F.col("batch_id") != batch_id).select("content_hash", "value")
        fresh = fresh.join(earlier, ["content_hash", "value"], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


# -- dead letters ----------------------------------------------------------


def dead_letters(rejects: DataFrame, failed_at: str | datetime | None = None, attempts: int = 1) -> DataFrame:
    """Rejected records with their original key and value and headers saying where and why."""
    at = F.current_timestamp() if failed_at is None else times.time_lit(failed_at)
    headers = {
        "dlq.source.topic": F.col("topic"),
        "dlq.source.partition": F.col("partition").cast("string"),
        "dlq.source.offset": F.col("offset").cast("string"),
        "dlq.error.class": F.col("error_class"),
        "dlq.error.reason": F.col("error_reason"),
        "dlq.attempts": F.lit(str(attempts)),
        "dlq.failed_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    }
    if "error_status" in rejects.columns:
        headers["dlq.error.status"] = F.col("error_status").cast("string")
    pairs = [item for name, value in headers.items() for item in (F.lit(name), value)]
    sent = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return rejects.where("error_class is not null").select("key", "value", "topic", "partition", "offset", sent.alias("headers"))


def unique_letters(letters: DataFrame) -> DataFrame:
    """The queue is at-least-once: one letter per source record."""
    return letters.dropDuplicates(["topic", "partition", "offset"])


def write_dead_letters(rejects: DataFrame, root: str, batch_id: int) -> None:
    dead_letters(rejects).write.mode("overwrite").parquet(batch_folder(root, batch_id))


# -- routing and upkeep ----------------------------------------------------


def write_routed(df: DataFrame, root: str, batch_id: int) -> None:
    """Rows below the folder of their `destination`."""
    df.write.mode("overwrite").partitionBy("destination").parquet(batch_folder(root, batch_id))


def repartition_by_visitor(df: DataFrame, visitor: str = "anon_id", time: str = "event_timestamp", parts: int | None = None) -> DataFrame:
    """Keyed by visitor, so that one visitor's events keep their order."""
    keyed = df.repartition(visitor) if parts is None else df.repartition(parts, visitor)
    return keyed.sortWithinPartitions(visitor, time)


def expire(rows: DataFrame, now: str | datetime, days: int = 7, day: str = "dt") -> DataFrame:
    """What stays: days not older than ``days`` full days after they closed. Prunes whole folders."""
    oldest = (times.instant(now) - timedelta(days=days + 1)).date()
    return rows.where(F.col(day) >= F.lit(oldest.isoformat()))


def expire_folders(spark: SparkSession, root: str, now: str | datetime, days: int = 7) -> list[str]:
    """Drops the `dt=` folders below ``root`` that `expire` leaves out; returns them."""
    oldest = (times.instant(now) - timedelta(days=days + 1)).date().isoformat()
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in fs.globStatus(jvm_path(f"{root}/*/*/dt=*")) or []:
        folder = status.getPath()
        if folder.getName().removeprefix("dt=") < oldest:
            fs.delete(folder, True)
            dropped.append(folder.toString())
    return dropped


# -- bookkeeping -----------------------------------------------------------


def ingest_counters(prepared: DataFrame, existing_ids: DataFrame | None = None) -> DataFrame:
    """(counter, label, count): consumed by topic, written by outcome, rejected by class.

    The first copy of an id is `created`; later copies, and ids already there, are `already_written`.
    The records are read once: each is noted under `consumed` and under its outcome, and notes are summed up before they are exchanged.
    """
    bad, no_id = F.col("error_class").isNotNull(), F.lit(None).cast("string")
    noted = lambda counter, label, ids: F.struct(F.lit(counter).alias("counter"), label.alias("label"), *[i.alias(c) for c, i in ids.items()])
    outcome = F.when(bad, noted("rejected", F.col("error_class"), dict.fromkeys(ID_KEY, no_id))).otherwise(
        noted("written", no_id, {c: F.col(c) for c in ID_KEY})
    )
    notes = prepared.select(F.inline(F.array(noted("consumed", F.col("topic"), dict.fromkeys(ID_KEY, no_id)), outcome)))
    sums = notes.groupBy("counter", "label", *ID_KEY).agg(F.count(F.lit(1)).alias("n"))
    if existing_ids is None:
        sums = sums.withColumn("known", F.lit(False))
    else:
        known = existing_ids.select(*ID_KEY).distinct().withColumn("known", F.lit(True))
        sums = sums.join(known, list(ID_KEY), "left").fillna(False, ["known"])
    created = F.when(F.col("known"), 0).otherwise(1).cast("long")
    count = lambda label, n: F.struct(label.alias("label"), n.alias("count"))
    split = F.array(count(F.lit("created"), created), count(F.lit("already_written"), F.col("n") - created))
    counts = sums.select("counter", F.inline(F.when(F.col("counter") == "written", split).otherwise(F.array(count(F.col("label"), F.col("n"))))))
    # Both outcomes are listed, whatever there was.
    none = prepared.sparkSession.sql("SELECT 'written' AS counter, label, cast(NULL AS bigint) AS count FROM VALUES ('created'), ('already_written') AS t(label)")
    counts = counts.unionByName(none)
    return counts.groupBy("counter", "label").agg(F.sum("count").alias("count"))


def dedup_audit(sent: DataFrame, written: DataFrame, letters: DataFrame) -> DataFrame:
    """Replay check, one row: each sound id written exactly once, each bad record in the dead letters.

    ``sent`` has org, workspace and `event_id` (null for unsound records) and the source coordinates.
    """
    sides = sent.where("event_id is not null").select(*ID_KEY, F.lit(1).alias("sent"), F.lit(0).alias("written"))
    sides = sides.unionByName(written.select(*ID_KEY, F.lit(0).alias("sent"), F.lit(1).alias("written")))
    per_id = sides.groupBy(*ID_KEY).agg(F.sum("sent").alias("sent"), F.sum("written").alias("written"))
    ids = per_id.agg(
        F.count_if(F.expr("sent > 0")).alias("valid_ids"),
        F.sum("written").alias("written_rows"),
        F.count_if(F.expr("sent > 0 and written = 0")).alias("missing_ids"),
        F.count_if(F.expr("written > 1")).alias("duplicated_ids"),
        F.count_if(F.expr("sent = 0")).alias("unexpected_ids"),
        (F.sum("sent") - F.count_if(F.expr("sent > 0"))).alias("resent"),
    )
    bad = sent.where("event_id is null").select("topic", "partition", "offset").distinct().agg(F.count(F.lit(1))).scalar()
    dead = letters.select("topic", "partition", "offset").distinct().agg(F.count(F.lit(1))).scalar()
    return ids.withColumn("bad_records", bad).withColumn("dead_letters", dead)
