"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (md5 of the text, md5 of the doc_id, place in the input), so equal texts stand together and equal rows can be parted. Splitters come from rounds of probing: each round
counts, in all partitions, the exact bytes below candidate boundaries (one more run of hex digits under every interval that
still holds a splitter) and narrows each interval, until every splitter lies between two adjacent keys. Then rows are
exchanged once. A round returns at most 256 counts per splitter, whatever the table's size. A run of equal leading digits, as under a
text that is a third of the table, is skipped in one step, and such a group is split by doc_id, and rows equal in both by their place.

Law ``bytes``: row r goes to shard floor(n * bytes before r / all bytes). A group of equal texts stays whole when it holds at most a
fiftieth of a shard, or no more than the largest row; it then goes where its first row goes. Sizes therefore differ from the mean by
no more than that.

Defined results: a null text counts as no bytes, so its size is the 16 of its frame, as for an empty text; null doc_ids sort by the
empty name; equal rows are interchangeable and are parted like others; an empty table gives no rows; one row goes to shard 0.
Columns of other names are carried by ``shard_documents`` unless they are called shard or slot, which it replaces.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import place_in, stored, text_of
from tidemark.session import small_side

FRAME = 16
WHOLE = 50
KEY_DIGITS = 32
FIRST_DIGITS, NEXT_DIGITS = 3, 2
#: Sorts after every hex digit.
AFTER = "~"


def sized() -> Column:
    return F.octet_length(text_of()).cast("long") + FRAME


def sort_key() -> Column:
    """Text, doc_id, and the row's place in its input, which parts equal rows; to be written to files before it is compared."""
    place = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    return F.concat(F.md5(text_of()), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), place)


def _probe(rows: DataFrame, intervals: set[str]) -> dict[str, list]:
    """Counts below each interval's candidates: (first key, last key, bytes), in key order."""
    lengths = sorted({len(p) for p in intervals})
    key = F.col("key")
    bins = []
    for length in lengths:
        step = FIRST_DIGITS if length == 0 else NEXT_DIGITS
        inside = F.lit(True) if length == 0 else F.substring(key, 1, length).isin([p for p in intervals if len(p) == length])
        bins.append(F.when(inside, F.struct(F.lit(length).alias("length"), F.substring(key, 1, length + step).alias("bin"))))
    counted = (
        rows.select("key", "size", F.explode(F.array_compact(F.array(*bins))).alias("at"))
        .groupBy("at")
        .agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("bytes"))
        .collect()
    )
    found: dict[str, list] = {p: [] for p in intervals}
    for row in sorted(counted, key=lambda r: r["low"]):
        found[row["low"][: row["at"]["length"]]].append((row["low"], row["high"], row["bytes"]))
    return found


def splitters(rows: DataFrame, shards: int, total: int, largest: int, grain: int) -> list[str]:
    """The n - 1 boundaries; a key belongs to the shard that equals the number of boundaries below it.

    ``grain``: groups of at most total / grain bytes stay whole.
    """
    waiting = {i: ("", 0) for i in range(1, shards)} if total else {}
    last_below: dict[int, str] = {}
    while waiting:
        counted = _probe(rows, {prefix for prefix, _ in waiting.values()})
        narrowed = {}
        for i, (prefix, below) in waiting.items():
            for low, high, size in counted[prefix]:
                if shards * (below + size) >= i * total:
                    if low == high:
                        last_below[i] = high
                    else:
                        narrowed[i] = (os.path.commonprefix([low, high]), below)
                    break
                below += size
        waiting = narrowed
    texts = {key[:KEY_DIGITS] for key in last_below.values()}
    group = F.substring("key", 1, KEY_DIGITS)
    held = rows.filter(group.isin(list(texts))).groupBy(group.alias("g")).agg(F.sum("size").alias("bytes")).collect() if texts else []
    whole = {r["g"] for r in held if r["bytes"] * grain <= total or r["bytes"] <= largest}
    return [(k[:KEY_DIGITS] if k[:KEY_DIGITS] in whole else k) + AFTER for _, k in sorted(last_below.items())]


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (key, size and more, the same at every read) with shard and slot.

    Slots are numbered where the rows stand after an exchange by ranges of (shard, key), and begin at the number of rows that the shard
    has in the ranges before; those are one number for each range and shard in it.
    """
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    total, largest = sums
    bounds = splitters(rows, shards, total, largest, shards * WHOLE)
    placed = rows.withColumn("shard", place_in(bounds, F.col("key")))
    ranged = stored(placed.repartitionByRange("shard", "key").withColumn("range", F.spark_partition_id()), "shard-ranges")
    held = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows")).collect()
    bases, seen = [], dict.fromkeys(range(shards), 0)
    for row in sorted(held, key=lambda r: r["range"]):
        bases.append((row["shard"], row["range"], seen[row["shard"]]))
        seen[row["shard"]] += row["rows"]
    starts = small_side(rows.sparkSession.createDataFrame(bases, "shard int, range int, base long"))
    number = F.expr("row_number() over (partition by shard, range order by key)")
    based = ranged.join(starts, ["shard", "range"])
    return based.withColumn("slot", F.col("base") + number.cast("long") - 1).drop("range", "base")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row, kept on shared files for the rounds."""
    return stored(docs.select("doc_id", sized().alias("size"), F.crc32(text_of()).alias("text_crc32"), sort_key().alias("key")), "shard-keys")


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Whole documents with their shard and slot, for writing with ``partitionBy("shard")``."""
    rest = docs.drop("shard", "slot")
    rows = stored(rest.select(F.struct("*").alias("whole"), sized().alias("size"), sort_key().alias("key")), "shard-rows")
    return assign(rows, shards).select("whole.*", "shard", "slot")
