"""Bulk requests of a consumer: each partition of the log cut into batches by number and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_DOCS, MAX_BYTES = 1_000, 5 * 1024 * 1024


def _cut(max_docs: int, max_bytes: int):
    """For ``mapInArrow`` over rows in order of topic, partition and offset: adds the number of each row's batch in its partition.

    Only the open batch's number of rows and bytes is carried from one Arrow batch to the next, whatever a partition's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, batch, docs, held = None, 0, 0, 0
        for rows in batches:
            keys = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
            sizes = np.asarray(rows.column(3)).astype(np.int64)
            numbers = np.empty(len(keys), np.int64)
            start = 0
            while start < len(keys):
                if keys[start] != at:
                    at, batch, docs, held = keys[start], 0, 0, 0
                end = next((n for n in range(start, len(keys)) if keys[n] != at), len(keys))
                total = np.cumsum(sizes[start:end])
                place, before = 0, 0
                while place < end - start:
                    fits = int(np.searchsorted(total, before + max_bytes - held, side="right"))
                    stop = min(fits, place + max_docs - docs, end - start)
                    if stop <= place:
                        if docs:  # the open batch takes no more
                            batch, docs, held = batch + 1, 0, 0
                            continue
                        stop = place + 1  # a batch takes at least one row
                    numbers[start + place : start + stop] = batch
                    docs, held = docs + stop - place, held + int(total[stop - 1]) - before
                    place, before = stop, int(total[stop - 1])
                start = end
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers)], [*rows.schema.names, "batch"])

    return run


def linger_batches(records: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(topic, partition, offset, size) with ``batch``: the oldest rows first, until the next would pass ``max_docs`` rows or ``max_bytes`` bytes.

    A row larger than ``max_bytes`` is a batch of its own. A partition of the log is read in order by one task, as one consumer reads it; rows stream
    through and nothing is collected.
    """
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    names = ("topic", "partition", "offset", "size")
    ordered = records.select(*names).repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return ordered.mapInArrow(_cut(max_docs, max_bytes), ", ".join(f"{n} {kinds[n]}" for n in names) + ", batch long")


def batch_sizes(cut: DataFrame) -> DataFrame:
    """Rows, bytes and offsets of each batch."""
    return cut.groupBy("topic", "partition", "batch").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("size").cast("long")).alias("bytes"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )
