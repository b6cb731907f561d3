"""Streaming queries. Delivery is at least once; batch ids and event ids make it exactly once in effect."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.functions import documents, times
from tidemark.operators.ingest import (
    ID_KEY,
    check_destination,
    classify_archive,
    conform,
    conform_sound,
    decode,
    opened,
    own_workspace,
    reject_large,
    resolve_setting,
)
from tidemark.session import keep
from tidemark.streaming import archive, sinks
from tidemark.streaming.cycles import STATE_STORE

CYCLE_S, CYCLE_ROWS = 60, 10_000
DEFAULT_TEMPLATE = "events-{org_id}-{workspace_id}"
MAX_BYTES = 5 * 1024 * 1024


def rate_options(max_docs: int | None = None, linger_s: float | None = None) -> dict[str, str]:
    """Source and trigger settings that bound a batch by size and time."""
    options = {}
    if max_docs:
        options["maxOffsetsPerTrigger"] = str(max_docs)
    if linger_s:
        options["processingTime"] = f"{linger_s} seconds"
    return options


def _start(writer: DataStreamWriter, checkpoint: str, every_s: float | None) -> StreamingQuery:
    """``every_s`` None drains what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if every_s is None else writer.trigger(processingTime=f"{every_s} seconds")
    return timed.start()


def foreach_batch_once(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every_s: float | None = None
) -> StreamingQuery:
    """Offsets move only after ``write`` has returned; a repeated batch comes with the same id."""
    return _start(stream.writeStream.foreachBatch(write), checkpoint, every_s)


def prepare(
    raw: DataFrame,
    overrides: DataFrame | None = None,
    template: str = DEFAULT_TEMPLATE,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Decoded records with `event_id` and `destination`, or the class and reason of their rejection."""
    fields = F.col("_fields")
    decoded = opened(raw).withColumns(
        {
            "event_id": documents.fence(documents.canonical_uuid(documents.field_text(fields, "id"))),
            "org_id": documents.fence(documents.field_text(fields, "org_id")),
            "workspace_id": documents.fence(documents.field_text(fields, "workspace_id")),
            "_class": F.col("error_class"),
            "_reason": F.col("error_reason"),
        }
    )
    settled = (
        decoded.withColumn("template", F.lit(template))
        if overrides is None
        else resolve_setting(decoded, overrides, template)
    )
    sized = reject_large(check_destination(settled), max_bytes)
    late = F.when(F.col("error_class").isNotNull(), F.col("error_class")).when(F.col("too_large"), "too_large")
    why = F.when(F.col("error_class").isNotNull(), F.col("error_reason")).when(
        F.col("too_large"), F.concat(F.lit("document is "), "request_bytes", F.lit(f" bytes; the limit is {max_bytes}"))
    )
    return sized.withColumns(
        {
            "error_class": documents.fence(F.when(F.col("_class").isNotNull(), F.col("_class")).otherwise(late)),
            "error_reason": F.when(F.col("_class").isNotNull(), F.col("_reason")).otherwise(why),
        }
    ).drop("_class", "_reason", "_fields", "too_large", "template")


def write_outcomes(prepared: DataFrame, path: str) -> None:
    """What became of each record, for readers that ask more than once: coordinates, ids and error, with key and value of the rejected ones."""
    bad = F.col("error_class").isNotNull()
    kept = [F.when(bad, F.col(c)).alias(c) for c in ("key", "value")]
    prepared.select("topic", "partition", "offset", "org_id", "workspace_id", "event_id", "error_class", "error_reason", *kept).write.parquet(path)


def start_ingest(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    overrides: DataFrame | None = None,
    template: str = DEFAULT_TEMPLATE,
    max_bytes: int = MAX_BYTES,
    every_s: float | None = None,
) -> StreamingQuery:
    """Every record ends up as a fact and catalog entry, or as a dead letter; all go to the archive.

    The raw batch is parsed once for the facts and dead letters and kept while they are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepared = keep(prepare(batch, overrides, template, max_bytes))
        try:
            rows = conform(prepared.where("error_class is null"))
            sinks.write_facts(rows, f"{root}/facts", batch_id)
            sinks.keep_merged(batch.sparkSession, f"{root}/facts")
            sinks.write_catalog(rows, f"{root}/catalog", batch_id)
            sinks.write_dead_letters(prepared, f"{root}/dead_letters", batch_id)
        finally:
            prepared.unpersist()
        classified = keep(classify_archive(batch))
        try:
            archive.write_archive(classified, f"{root}/archive")
            sinks.write_quarantine(classified, root, batch_id)
        finally:
            classified.unpersist()

    return foreach_batch_once(stream, write, checkpoint, every_s)


def start_fact_sink(
    stream: DataFrame, root: str, checkpoint: str, workspace_id: str | None = None, every_s: float | None = None
) -> StreamingQuery:
    """Sound events into the fact table, of one workspace or of all, merged as batches come together. Late events are kept: no watermark."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = conform_sound(batch)
        sinks.write_facts(rows if workspace_id is None else own_workspace(rows, workspace_id), root, batch_id)
        sinks.keep_merged(batch.sparkSession, root)

    return foreach_batch_once(stream, write, checkpoint, every_s)


def start_catalog_sink(stream: DataFrame, root: str, checkpoint: str, every_s: float | None = None) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.write_catalog(conform(decode(batch).where("error_class is null")), root, batch_id)

    return foreach_batch_once(stream, write, checkpoint, every_s)


def start_archive(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    n: int = CYCLE_ROWS,
    seconds: float | None = CYCLE_S,
    source: str | None = None,
    created_at: str | None = None,
) -> StreamingQuery:
    """The archive cycle: every ``seconds`` what has arrived, in objects of at most ``n`` records with their manifests.

    Reading no more than ``n`` records per cycle is the source's rate option; firing early at exactly
    ``n`` records is not reproduced.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        classified = keep(classify_archive(batch))
        try:
            archive.write_archive(classified, root, n, source, created_at)
            sinks.write_quarantine(classified, root, batch_id)
        finally:
            classified.unpersist()

    return foreach_batch_once(stream, write, checkpoint, seconds)


def start_deduped(events: DataFrame, root: str, checkpoint: str, every_s: float | None = None) -> StreamingQuery:
    """Each event once, by (org, workspace, id), however late it or a copy of it comes and whatever event time the copy carries: no watermark.

    The ids of all time are keyed state. The store looks a batch's ids up by key, behind Bloom filters of its files, so a batch costs what it
    holds and not what came before; state is spread over the shuffle partitions of the first start. Of copies in one batch any one stays.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sinks.batch_folder(root, batch_id))

    conf.set(name, STATE_STORE)  # keeps its state on disk; a query takes it when it starts
    try:
        return foreach_batch_once(events.dropDuplicates(list(ID_KEY)), write, checkpoint, every_s)
    finally:
        conf.set(name, before)


# -- live views ------------------------------------------------------------


def start_histogram(events: DataFrame, interval: str, root: str, checkpoint: str, every_s=None) -> StreamingQuery:
    """Counts per bucket, kept current: each batch writes the buckets it changed."""
    width = times.HISTOGRAM_WIDTHS[interval]
    counts = events.groupBy(times.bucket_start(F.col("event_timestamp"), width).alias("time")).agg(
        F.count(F.lit(1)).alias("count")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sinks.batch_folder(root, batch_id))

    return _start(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, every_s)


def read_histogram(spark: SparkSession, root: str) -> DataFrame:
    """The latest count of each bucket."""
    rows = spark.read.schema("time timestamp, count long, batch_id long").parquet(root)
    return rows.groupBy("time").agg(F.max_by("count", "batch_id").alias("count"))


def start_refresh(
    ticks: DataFrame,
    run: Callable[[SparkSession, datetime], DataFrame],
    root: str,
    checkpoint: str,
    every_s: float | None = 5,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> StreamingQuery:
    """Re-runs a query whose range ends now whenever ``ticks`` delivers, and keeps each result by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run(batch.sparkSession, clock()).write.mode("overwrite").parquet(sinks.batch_folder(root, batch_id))

    return foreach_batch_once(ticks, write, checkpoint, every_s)


def latest_refresh(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(root)
    newest = rows.agg(F.max("batch_id")).scalar()
    return rows.where(F.col("batch_id") == newest).drop("batch_id")
