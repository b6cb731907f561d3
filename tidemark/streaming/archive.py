"""The archive's writer: content-named objects that appear only when their whole batch has been written.

Tasks write each object to a staging folder of the batch, hash its body on the way and list what they have staged. When all tasks are done, the lists are
committed and a second job publishes what they name, spread over tasks: an object's manifest first, then the object, each moved to the name that its content
gives it. A name that is taken holds the same content, so a repeated batch, or one that failed while it was
published, changes nothing that is there already. A batch that fails leaves only its staging folder, which readers skip and the next step removes.

    {root}/org=…/workspace=…/dt=…/hour=…/{hash}.jsonl.gz     payloads, each ended by ``RECORD_END``
    {root}/_manifests/org=…/…/{hash}.json                     event count, offset ranges, source, time

The hash is the first 16 hex digits of the SHA-256 of the payloads, each followed by a line end.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.sources.events import RECORD_END, folder_exists

FOLDER = ("org", "workspace", "dt", "hour")
BLOCK = 10_000
MOVERS = 4


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder in it."""
    return fs.FileSystem.from_uri(f"file://{root[5:]}" if root.startswith("file:/") and not root.startswith("file://") else root)


@dataclass
class Staged(WriterCommitMessage):
    """The list of what a task has staged."""

    listing: str


LISTED = "body string, manifest string, folder string, digest string"


class ArchiveWriter(DataSourceArrowWriter):
    """Takes rows in order of FOLDER, topic, partition, block and offset; each block is an object."""

    def __init__(self, options):
        self.root, self.stage = options["path"], options["stage"]
        self.source, self.created_at = options.get("source"), options.get("createdAt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = _open(self.root)
        stage = f"{root}/{self.stage}"
        store.create_dir(stage, recursive=True)
        rows = (row for batch in iterator for row in batch.to_pylist())
        key = lambda row: (*(row[c] for c in FOLDER), row["topic"], row["partition"], row["block"])
        listing = f"{stage}/{uuid.uuid4().hex}.list"
        with store.open_output_stream(listing) as out:
            for place, held in groupby(rows, key):
                out.write(json.dumps(self._object(store, stage, place, held)).encode() + b"\n")
        return Staged(listing)

    def _object(self, store: fs.FileSystem, stage: str, key: tuple, rows: Iterator[dict]) -> dict[str, str]:
        """One object, written payload by payload; a task holds no more than the payload at hand."""
        name, digest, count, first, last = f"{stage}/{uuid.uuid4().hex}", hashlib.sha256(), 0, None, None
        with store.open_output_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as body:
            for row in rows:
                payload = row["value"].encode()
                digest.update(payload + b"\n")
                body.write(payload + RECORD_END.encode())
                count, first, last = count + 1, row["offset"] if first is None else first, row["offset"]
        manifest = {"event_count": count, "ranges": f"{key[4]}:{key[5]}:{first}:{last}", "created_at": self.created_at}
        if self.source is not None:
            manifest["source"] = self.source
        folder = "/".join(f"{c}={quote(str(v), safe=' ')}" for c, v in zip(FOLDER, key, strict=False))
        return {"body": name, "manifest": json.dumps(manifest), "folder": folder, "digest": digest.hexdigest()[:16]}

    def commit(self, messages: list[Staged | None]) -> None:
        """Only the lists of tasks that count are published; what a lost attempt has staged goes with the folder."""
        store, root = _open(self.root)
        lists = f"{root}/{self.stage}/lists"
        store.create_dir(lists, recursive=True)
        for message in filter(None, messages):
            store.move(message.listing, f"{lists}/{message.listing.rpartition('/')[2]}")

    def abort(self, messages: list[Staged | None]) -> None:
        _drop(self.root, self.stage)


def _drop(path: str, stage: str) -> None:
    store, root = _open(path)
    if store.get_file_info(f"{root}/{stage}").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/{stage}")


def _publisher(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over listed objects: moves each to its place unless the same content is there, and counts those moved.

    A task that is run again, or beside itself, finds done what the other has moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        there = lambda place: store.get_file_info(place).type != fs.FileType.NotFound
        made: set[str] = set()

        def move(source: str, place: str) -> None:
            folder = place.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            try:
                store.move(source, place)
            except OSError:
                if not there(place):
                    raise

        def publish(listed: dict[str, str]) -> int:
            target = f"{root}/{listed['folder']}/{listed['digest']}.jsonl.gz"
            if there(target):
                return 0  # the same content is there
            manifest = f"{listed['body']}.{uuid.uuid4().hex}.json"
            with store.open_output_stream(manifest) as out:
                out.write(listed["manifest"].encode())
            move(manifest, f"{root}/_manifests/{listed['folder']}/{listed['digest']}.json")
            move(listed["body"], target)
            return 1

        with ThreadPoolExecutor(MOVERS) as pool:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"moved": pa.array([sum(pool.map(publish, batch.to_pylist()))], pa.int64())})

    return run


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def write_archive(classified: DataFrame, root: str, max_rows: int = BLOCK, source: str | None = None, created_at: str | None = None) -> None:
    """Payloads verbatim, in (topic, partition, offset) order, below org/workspace/dt/hour.

    An object holds the payloads of an hour from one block of one partition's offsets, so a busy hour is split over tasks.
    """
    spark = classified.sparkSession
    spark.dataSource.register(ArchiveSource)
    routed = classified.where("reason is null").withColumn("block", F.floor(F.col("offset") / max_rows))
    place = (*FOLDER, "topic", "partition", "block")
    laid_out = routed.repartition(*place).sortWithinPartitions(*place, "offset").select(*place, "offset", "value")
    created = created_at or spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
    stage = f"_staging/{uuid.uuid4().hex}"
    writer = laid_out.write.format(ArchiveSource.name()).mode("append").option("createdAt", created).option("stage", stage)
    (writer if source is None else writer.option("source", source)).save(root)
    try:
        if folder_exists(spark, f"{root}/{stage}/lists"):
            listed = spark.read.schema(LISTED).json(f"{root}/{stage}/lists").dropDuplicates(["folder", "digest"])
            # A given number of parts: the lists are small, the work on what they name is not.
            spread = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder", "digest")
            spread.mapInArrow(_publisher(root), "moved long").agg(F.sum("moved")).collect()
    finally:
        _drop(root, stage)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per archived object: folder, content hash, event count, ranges, source and time."""
    schema = "event_count long, ranges string, source string, created_at timestamp, org string, workspace string, dt string, hour int"
    if not folder_exists(spark, f"{root}/_manifests"):
        return spark.createDataFrame([], schema + ", content_hash string")
    rows = spark.read.schema(schema).json(f"{root}/_manifests")
    return rows.withColumn("content_hash", F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+)\.json$", 1))


def folder_manifests(objects: DataFrame) -> DataFrame:
    """Per folder: event count, `topic:partition:first:last` ranges in the order their first offset was seen, source and time."""
    parts = objects.withColumn("range", F.explode(F.split("ranges", ";")))
    item = lambda n: F.regexp_extract("range", r"^(.*):(\d+):(\d+):(\d+)$", n)
    numbers = [item(n).cast("long").alias(c) for n, c in ((2, "partition"), (3, "low"), (4, "high"))]
    parts = parts.select(*FOLDER, item(1).alias("topic"), *numbers)
    merged = parts.groupBy(*FOLDER, "topic", "partition").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    text = F.concat_ws(":", "topic", "partition", "low", "high")
    listed = F.sort_array(F.collect_list(F.struct("low", "topic", "partition", text.alias("text"))))
    ranges = merged.groupBy(*FOLDER).agg(F.concat_ws(";", F.transform(listed, lambda r: r["text"])).alias("ranges"))
    sums = objects.groupBy(*FOLDER).agg(F.sum("event_count").alias("event_count"), F.first("source").alias("source"), F.max("created_at").alias("created_at"))
    return sums.join(ranges, list(FOLDER)).select(*FOLDER, "event_count", "ranges", "source", "created_at")
