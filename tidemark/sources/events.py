"""Batch and streaming sources of events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import documents, props, times
from tidemark.model import ENVELOP_VERSION, FACT_COLUMNS, FACT_SCHEMA, RAW_SCHEMA, Scope
from tidemark.operators.ingest import drop_deleted
from tidemark.session import small_side
from tidemark.sources.versions import Batch, Run, Versions


def read_event_stream(spark: SparkSession, source: str | Mapping[str, str], files_per_trigger: int | None = None) -> DataFrame:
    """A stream of log rows (`RAW_SCHEMA`).

    A mapping holds Kafka options, where `subscribePattern` follows topics as they appear. A text is a
    folder (or glob) of Parquet files with the same columns, for replays and tests.
    """
    if isinstance(source, str):
        reader = spark.readStream.schema(RAW_SCHEMA)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(source)
    rows = spark.readStream.format("kafka").options(**source).load()
    return rows.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset"
    )


def topic_options(servers: str, topics: list[str], refresh_s: int = 30, max_offsets: int | None = None) -> dict[str, str]:
    """Kafka options for a topic list whose `^` entries are patterns; new topics join on refresh."""
    options = {"kafka.bootstrap.servers": servers, "kafka.metadata.max.age.ms": str(refresh_s * 1000)}
    if any(topic.startswith("^") for topic in topics):
        plain = [topic if topic.startswith("^") else "^" + topic.replace(".", r"\.") + "$" for topic in topics]
        options["subscribePattern"] = "|".join(f"({topic})" for topic in plain)
    else:
        options["subscribe"] = ",".join(topics)
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def _is_sound(document: Column) -> Column:
    return documents.let(
        documents.fields_of(document), lambda fields: documents.canonical_problem(fields, ENVELOP_VERSION).isNull()
    )


def explode_batches(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Events of `{"events":[…],"system_properties":…}` bodies, with their position.

    The batch's system properties replace each event's own, even when the batch has none. One unsound
    event, or an unreadable body, drops the whole body.
    """
    rest = [c for c in bodies.columns if c != body]
    parsed = bodies.withColumn("_doc", documents.fence(documents.whole_json(F.col(body)))).withColumns(
        {
            "_events": F.try_variant_get("_doc", "$.events", "array<variant>"),
            "_system": F.try_variant_get("_doc", "$.system_properties", "variant"),
        }
    )
    sound = F.forall("_events", _is_sound)
    events = parsed.where(sound).select(*rest, "_system", F.posexplode("_events").alias("pos", "_event"))
    own = F.map_filter(props.children(F.col("_event")), lambda key, _: key != "system_properties")
    system = F.when(
        F.col("_system").isNotNull(), F.map_concat(own, F.create_map(F.lit("system_properties"), F.col("_system")))
    ).otherwise(own)
    return events.select(*rest, "pos", F.to_variant_object(system).alias("document"))


def split_concatenated(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Events of bodies that hold one JSON object per line; one bad line drops the whole body."""
    rest = [c for c in bodies.columns if c != body]
    lines = F.filter(F.split(F.col(body), "\n"), lambda line: F.trim(line) != "")
    parsed = bodies.withColumn("_docs", documents.fence(F.transform(lines, documents.whole_json)))
    return parsed.where(F.forall("_docs", _is_sound)).select(*rest, F.posexplode("_docs").alias("pos", "document"))


_STORED = T.StructType([T.StructField("month", T.StringType())] + list(FACT_SCHEMA.fields))
#: What places a fact row in the table.
PART = ("org_id", "workspace_id", "month")


def batch_ids(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches that no merge has taken in yet."""
    versions = Versions(spark, root)
    return [b.batch_id for b in versions.fresh(versions.current())]


def _read(spark: SparkSession, base: str, part: str, names: list[str]) -> DataFrame:
    """Stored rows of the named folders below ``base``, whose last level is the partition ``part``."""
    if not names:
        return spark.createDataFrame([], _STORED).select(*FACT_COLUMNS, "month")
    schema = T.StructType([T.StructField(part, T.StringType()), *_STORED.fields])
    rows = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{n}" for n in names])
    return rows.select(*FACT_COLUMNS, "month")


def fresh_rows(spark: SparkSession, root: str, batches: Sequence[Batch]) -> DataFrame:
    """All versions in the given batches."""
    return _read(spark, root, "batch_id", [b.name for b in batches])


def run_rows(spark: SparkSession, root: str, runs: Sequence[Run]) -> DataFrame:
    """The rows of the given runs, deletions among them; each run holds one version per key."""
    return _read(spark, f"{root}/_runs", "run", [r.name.removeprefix("_runs/") for r in runs])


def facts(spark: SparkSession, root: str, scope: Scope | None = None, rng=None, raw: bool = False) -> DataFrame:
    """The fact table of one scope: partitions pruned by org, workspace and month, latest versions only.

    Reads the newest published version of the table and the batches it has not taken in, so a merge that runs meanwhile shows
    whole or not at all. A run holds one version per key: rows of the largest run are read as they are, without a shuffle,
    but for partitions that a smaller run or a batch has touched, where versions are resolved. A folder that does not exist yet is an
    empty table. ``raw`` gives every stored version.
    """
    versions = Versions(spark, root)
    manifest = versions.current()
    batches = versions.fresh(manifest)

    def wanted(rows: DataFrame) -> DataFrame:
        if scope is not None:
            rows = rows.where((F.col("workspace_id") == scope.workspace_id) & (F.col("org_id") == scope.org_id))
        if rng is not None:
            start, end = times.instant(rng[0]), times.instant(rng[1])
            rows = rows.where(F.col("month").between(f"{start:%Y%m}", f"{end:%Y%m}")).where(
                times.closed(F.col("event_timestamp"), start, end)
            )
        return rows

    runs = sorted(manifest.runs, key=lambda run: -run.size)
    largest = wanted(run_rows(spark, root, runs[:1]))
    if not batches and len(runs) < 2:
        return (largest if raw else largest.where("is_deleted = 0")).select(*FACT_COLUMNS)
    newer = wanted(run_rows(spark, root, runs[1:]).unionByName(fresh_rows(spark, root, batches)))
    if raw:
        return largest.unionByName(newer).select(*FACT_COLUMNS)
    touched = small_side(newer.select(*PART).distinct())
    open_rows = largest.join(touched, list(PART), "left_semi").unionByName(newer)
    settled = largest.where("is_deleted = 0").join(touched, list(PART), "left_anti")
    return settled.select(*FACT_COLUMNS).unionByName(drop_deleted(open_rows.select(*FACT_COLUMNS)))


#: Ends an archived record: a control character that no JSON text holds unescaped, and a line end.
RECORD_END = "\x1e\n"


def read_archive(spark: SparkSession, root: str, scope: Scope | None = None, days=None, once: bool = True) -> DataFrame:
    """Archived payloads (`org`, `workspace`, `dt`, `hour`, `value`), pruned by folder.

    The archive may hold an event twice; ``once`` keeps one payload per event id.
    """
    schema = "value string, org string, workspace string, dt string, hour int"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/org=*")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):  # nothing published yet
        return spark.createDataFrame([], schema).select("org", "workspace", "dt", "hour", "value")
    rows = spark.read.schema(schema).text(root, lineSep=RECORD_END)
    if scope is not None:
        rows = rows.where((F.col("org") == scope.org_id) & (F.col("workspace") == scope.workspace_id))
    if days is not None:
        rows = rows.where(F.col("dt").between(*days))
    rows = rows.select("org", "workspace", "dt", "hour", "value")
    if not once:
        return rows
    # A line without an id cannot be told from a copy, so all of them stay.
    keyed = rows.withColumn("event_id", F.get_json_object("value", "$.id"))
    unique = keyed.where("event_id is not null").dropDuplicates(["org", "workspace", "event_id"])
    return unique.unionByName(keyed.where("event_id is null"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
