"""Exact duplicates through an extendible-hash index on shared files.

Texts are equal when they agree after all characters of ``[\\x20\\x09-\\x0D]`` are deleted. The pseudo-key of a text is the 64-bit hash
of what remains. A directory over the leading bits of the key starts with one bucket; a bucket with more bytes of distinct text than
the capacity is split on its next bit, and the directory doubles when that bucket already uses all its bits. Readers combine their copies
and send what is left, bytes included, to the owner of its bucket: a task with a range of keys. The owner chains the texts whose
keys collide, compares their bytes, and settles for each text which row stays and how many rows there are; its range of the index is
written to the shared folder, and every row takes its group from there. A text that is a third of the table reaches its owner in at most
READERS entries.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal texts the longest original (in code
points) stays, then the smallest doc_id (null last), then the row read first, so exactly one row of each group has ``kept``; an empty
table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import stored, text_of
from tidemark.session import scratch_dir

SPACES = "\t\n\x0b\x0c\r "
#: Distinct text of one bucket, in bytes.
CAPACITY = 1 << 20
#: The directory has at most 2 ** MAX_DEPTH slots, which bounds its broadcast (4 MB); beyond 64 GB of distinct text buckets grow with the
#: table, to 1.6 GB of text at 100 TB.
MAX_DEPTH = 18
#: Groups of readers that combine their copies before these go to the owners.
READERS = 16


@dataclass
class Index:
    path: str
    entries: DataFrame  # bucket, k, chain of (sha, n_bytes, keep_points, keep_id, group_size)
    rows: DataFrame  # row, doc_id, n_points, k, sha, n_bytes


def normalised(column: str = "text") -> Column:
    return F.translate(text_of(column), SPACES, "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, norm, pseudo-key k and SHA-256 of every row."""
    points = F.coalesce(F.char_length("text"), F.lit(0))
    rows = docs.select("doc_id", points.alias("n_points"), normalised().alias("norm"))
    return rows.withColumns({"k": F.xxhash64("norm"), "sha": F.sha2("norm", 256), "n_bytes": F.octet_length("norm").cast("long")})


def slot(key: Column, depth: int) -> Column:
    """The directory slot of a key: its leading bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def double_directory(load: dict[int, int], capacity: int) -> tuple[int, list[int]]:
    """Depth and the bucket of every slot, for the bytes under each prefix of MAX_DEPTH bits.

    Buckets are numbered in key order, so a run of buckets is a range of keys.
    """
    below = [0]
    for prefix in range(1 << MAX_DEPTH):
        below.append(below[-1] + load.get(prefix, 0))

    def size(bucket: tuple[int, int]) -> int:
        bits, prefix = bucket
        width = MAX_DEPTH - bits
        return below[(prefix + 1) << width] - below[prefix << width]

    depth, slots, waiting = 0, [(0, 0)], [(0, 0)]
    while waiting:
        bucket = waiting.pop()
        bits, prefix = bucket
        if bits == MAX_DEPTH or size(bucket) <= capacity:
            continue
        if bits == depth:
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        halves = [(bits + 1, prefix * 2), (bits + 1, prefix * 2 + 1)]
        span = 1 << (depth - bits - 1)
        for half in halves:
            slots[half[1] * span : (half[1] + 1) * span] = [half] * span
        waiting += halves
    numbers: dict[tuple[int, int], int] = {}
    return depth, [numbers.setdefault(b, len(numbers)) for b in slots]


def owned(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """bucket, k and the chain of its texts, settled by the owners of the buckets."""
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    placed = rows.withColumn("slot", slot(F.col("k"), depth)).join(directory, "slot")
    sent = placed.withColumn("reader", F.spark_partition_id() % READERS).groupBy("bucket", "k", "norm", "reader")
    sent = sent.agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).repartition("bucket")
    # From here on each owner works alone on its buckets: no further exchange follows.
    texts = sent.groupBy("bucket", "k", "norm").agg(F.min("first").alias("first"), F.sum("copies").alias("group_size"))
    entry = F.struct(
        F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"), (-F.col("first.n")).alias("keep_points"),
        F.col("first.doc_id").alias("keep_id"), "group_size",
    )
    return texts.select("bucket", "k", entry.alias("entry")).groupBy("bucket", "k").agg(F.sort_array(F.collect_list("entry")).alias("chain"))


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    spark = docs.sparkSession
    narrow = keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_points", "k", "sha", "n_bytes")
    rows = stored(narrow, "dedup-rows")  # without the text, which the owners' pass reads again
    sizes = rows.groupBy("k", "sha").agg(F.max("n_bytes").alias("n_bytes"))
    held = sizes.groupBy(slot(F.col("k"), MAX_DEPTH).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
    load = {r["prefix"]: r["bytes"] for r in held.collect()}  # at most 2 ** MAX_DEPTH rows
    capacity = max(capacity, sum(load.values()) >> (MAX_DEPTH - 2))
    depth, slots = double_directory(load, capacity)
    directory = F.broadcast(spark.createDataFrame(list(enumerate(slots)), "slot long, bucket int"))

    chains = owned(keyed(docs), directory, depth)
    path = scratch_dir(spark, "dedup-index")
    chains.sortWithinPartitions("bucket", "k").write.parquet(path)
    return Index(path, spark.read.schema(chains.schema).parquet(path), rows)


def decisions(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, n_points, k, sha, keep_id, group_size, kept, bucket, chained."""
    index = build_index(docs, capacity)
    # Rows equal in text, length and doc_id are told apart by the order they were read in: the first of them may stay.
    alike = index.rows.groupBy("k", "sha", "n_points", "doc_id").agg(F.min("row").alias("row"))
    rows = index.rows.join(alike.select("row", F.lit(True).alias("first")), "row", "left")
    probed = rows.join(index.entries, "k").withColumn("entry", F.filter("chain", lambda e: e["sha"] == F.col("sha"))[0])
    longest = (F.col("n_points") == F.col("entry.keep_points")) & F.col("doc_id").eqNullSafe(F.col("entry.keep_id"))
    return probed.select(
        "doc_id", "n_points", "k", "sha", F.col("entry.keep_id").alias("keep_id"), F.col("entry.group_size").alias("group_size"),
        (longest & F.coalesce("first", F.lit(False))).alias("kept"), "bucket", F.size("chain").alias("chained"),
    )


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents without all but one of each group, every column as it was."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    stays = decisions(docs, capacity).filter("kept").select("k", "sha", "n_points", name.alias("name"))
    whole = docs.select(F.struct("*").alias("whole"), "doc_id", "text")
    points = F.coalesce(F.char_length("text"), F.lit(0))
    rows = whole.withColumn("norm", normalised()).select(
        "whole", F.xxhash64("norm").alias("k"), F.sha2("norm", 256).alias("sha"), points.alias("n_points"), name.alias("name")
    )
    keys = ["k", "sha", "n_points", "name"]
    return rows.join(stays, keys, "left_semi").dropDuplicates(keys).select("whole.*")
