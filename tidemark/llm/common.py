"""Helpers the text operators share."""

from __future__ import annotations

import io
import os
import string
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import scratch_dir

#: Folds A-Z only, as the contracts ask; ``lower`` would also fold letters outside ASCII.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Later jobs read the files, so neither a lost executor nor a second use computes ``df`` anew.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def in_bucket(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the value as text leaves ``remainder``; null counts as the empty text."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(value) % modulus == remainder


def other_columns(docs: DataFrame, *named: str) -> list[str]:
    return [c for c in docs.columns if c not in named]


def id_type(docs: DataFrame) -> str:
    """The doc_id column of a result's schema."""
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


_memory: dict = {}


def only(key: tuple, make: Callable[[], Any]) -> Any:
    """What an operator remembers between the tasks of one Python worker.

    A worker serves one operator after the other; the last one's memory goes when the next asks, so they never add up.
    """
    if key not in _memory:
        _memory.clear()
        _memory[key] = make()
    return _memory[key]


def release() -> None:
    """Drops what another operator has left; every task that remembers nothing itself begins with this."""
    _memory.clear()


def place_in(bounds: list, key: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, by binary search over one array literal."""
    held, steps = F.array(*[F.lit(b) for b in bounds]), [1 << n for n in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    below = lambda at: F.get(held, at - 1) < key
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & below(at + step), at + step).otherwise(at))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application; Spark hands the file to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), f"{root.name}.zip")
    Path(path).write_bytes(held.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def slices(batch: pa.RecordBatch, size: int = 8 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, so memory follows the text and not the row count; no row is cut."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    groups = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)
