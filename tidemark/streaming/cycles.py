"""Archive cycles: a cycle fires when n records wait, or when its time is over, whichever comes first."""

from __future__ import annotations

import heapq
import tempfile
import time
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.events import folder_exists

RECORD = T.StructType([T.StructField("offset", T.LongType()), T.StructField("value", T.StringType())])
FIRED = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("cycle", T.LongType()),
        T.StructField("by", T.StringType()),
    ]
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Bytes of payloads that a task sorts in memory, and rows of a sorted run that it looks at together.
RUN_BYTES, RUN_ROWS = 32 << 20, 500
#: Rows that leave a task together, in whole cycles.
OUT_ROWS = 5_000

_PLAIN = pa.schema([("offset", pa.int64()), ("value", pa.large_string())])


def _order(row: tuple) -> tuple:
    return row[0], row[1] is None, row[1] or ""


def _run(file: Any) -> Iterator[tuple]:
    file.seek(0)
    for batch in pa.ipc.open_stream(file):
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def in_order(parts: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(offset, value) of a key's rows by offset. Rows beyond ``RUN_BYTES`` wait as sorted runs in the task's scratch files, so that a long
    partition of the log takes no more memory than a short one."""
    with tempfile.TemporaryDirectory() as folder:
        runs: list[Iterator[tuple]] = []
        held, size = [], 0

        def stored(rows: list) -> Iterator[tuple]:
            file = open(f"{folder}/{len(runs)}", "w+b")  # noqa: SIM115
            with pa.ipc.new_stream(file, _PLAIN) as out:
                for start in range(0, len(rows), RUN_ROWS):
                    columns = zip(*rows[start : start + RUN_ROWS], strict=True)
                    out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PLAIN, strict=True)], schema=_PLAIN))
            return _run(file)

        for part in parts:
            for offset, value in zip(part["offset"], part["value"], strict=True):
                held.append((int(offset), value))
                size += 100 + len(value or "")
            if size > RUN_BYTES:
                runs.append(stored(sorted(held, key=_order)))
                held, size = [], 0
        yield from heapq.merge(*runs, sorted(held, key=_order), key=_order)


class Cycles(StatefulProcessor):
    """Keeps the records of one partition of the log that wait for their cycle, in order of offset.

    A cycle by number takes exactly ``n`` and leaves the surplus, which may fire the next one at once. A cycle by time takes all; it finds at least one
    record, as the timer runs only while something waits. Every cycle starts the time anew.
    """

    def __init__(self, n: int, seconds: float):
        self.n, self.wait_ms = n, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", RECORD)
        self.counted = handle.getValueState("counted", T.StructType([T.StructField("cycles", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        held, done = (row for some in (waiting, in_order(rows)) for row in some), self._done()
        fired, cycle, out = done, [], []
        while len(cycle := list(islice(held, self.n))) == self.n:
            out += [(*row[:2], fired) for row in cycle]
            fired += 1
            if len(out) >= OUT_ROWS:
                yield self._fired(key, out, "number")
                out = []
        if out:
            yield self._fired(key, out, "number")
        if fired > done:
            self.counted.update((fired,))
        self._keep([tuple(row[:2]) for row in cycle], timerValues, fired > done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if held:
            done = self._done()
            self.counted.update((done + 1,))
            yield self._fired(key, [(*row[:2], done) for row in held], "time")
        self._keep([], timerValues, True)

    def _done(self) -> int:
        return self.counted.get()[0] if self.counted.exists() else 0

    def _fired(self, key: Any, rows: list, by: str) -> pd.DataFrame:
        offsets, values, cycles = zip(*rows, strict=True)
        return pd.DataFrame({"topic": key[0], "partition": key[1], "offset": offsets, "value": values, "cycle": cycles, "by": by})

    def _keep(self, rows: list, timerValues: Any, restart: bool) -> None:
        timers = [timer[0] if isinstance(timer, tuple) else timer for timer in self.handle.listTimers()]
        if restart or not rows:
            for timer in timers:
                self.handle.deleteTimer(timer)
            timers = []
        if rows:
            self.waiting.put(rows)
            if not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def cycles(stream: DataFrame, n: int, seconds: float) -> DataFrame:
    """The records of a log stream as they leave in cycles: `cycle` counts those of a partition, `by` says what fired it."""
    records = stream.select("topic", "partition", "offset", "value")
    return records.groupBy("topic", "partition").transformWithStateInPandas(Cycles(n, seconds), FIRED, "append", "processingTime")


def start_cycles(stream: DataFrame, n: int, seconds: float, root: str, checkpoint: str, every_s: float = 1) -> StreamingQuery:
    """Cycles as Parquet rows below ``root``; the file sink's log makes a repeated batch count once."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)  # the only one that keeps lists and timers; a query takes it when it starts
    try:
        writer: DataStreamWriter = cycles(stream, n, seconds).writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(processingTime=f"{every_s} seconds").start()
    finally:
        conf.set(name, before)


def read_cycles(spark: SparkSession, root: str) -> DataFrame:
    """The records of all cycles so far; none before the first."""
    if not folder_exists(spark, f"{root}/_spark_metadata"):
        return spark.createDataFrame([], FIRED)
    return spark.read.schema(FIRED).parquet(root)


def await_records(query: StreamingQuery, root: str, wanted: int, seconds: float) -> None:
    """Waits until ``wanted`` records have left in cycles."""
    spark, until = SparkSession.active(), time.monotonic() + seconds
    while read_cycles(spark, root).count() < wanted:
        if query.exception() is not None:
            raise query.exception()
        if time.monotonic() > until:
            raise TimeoutError(f"fewer than {wanted} records after {seconds} seconds")
        time.sleep(0.5)
