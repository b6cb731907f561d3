"""Token ids in ORC files, in ascending doc_id order.

Rows are dealt to tasks by ranges of doc_id (then of the text's hash and of the row's place in its input, so neither repeated ids nor repeated rows meet in one task) and written in that order:
file after file, each holding its range. Ids are integers in ORC's run-length encoding; stripes can be read in parallel;
a row index every ``STRIDE`` rows and a Bloom filter on doc_id let a reader skip stripes and row groups by metadata alone. Each row also
holds its number of ids and that of the ids before it in its file, so the place of a document in the whole stream is that number and one sum per file.

Segments (a run of white space and what follows up to the next one) are remembered per worker, at most ``REMEMBERED``; new
ones go through the tokenizers library. The split is exact: the pre-tokenizer always ends a token before a blank that follows a visible
character. Texts for which the quick split could differ (double blanks, other white space at a segment's ends) go through the library whole.

Defined results: a null text counts as empty and has the end id alone; a text of any length is one row; rows with equal doc_id stand
together, null ids first; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import id_type, only, release, ship, slices, text_of
from tidemark.session import small_side

STRIDE = 1_000
STRIPE = 64 << 20
REMEMBERED = 500_000
#: Runs of signs remembered beside the segments.
RUNS = 10_000
END_ID = 0
#: An optional line break, letters (and such numbers as ``isalpha`` sorts out), ASCII signs up to the end.
_SHAPE = re.compile(r"(\n?)([^\W\d_]+)([!-/:-@\[-`{-~]*)")


class _Whole(Exception):
    """This text can't be split at blanks."""


def _high_bytes(split) -> dict[str, str]:
    """For the bytes of UTF-8 from 128 on, read as Latin-1, the characters that stand for them."""
    found: dict[str, str] = {}
    for point in [*range(0x80, 0x800), *range(0x800, 0x10000, 61), *range(0x10000, 0x110000, 997)]:
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        signs = "".join(part for part, _ in split(letter))
        raw = letter.encode().decode("latin-1")
        if len(signs) == len(raw):
            found.update(zip(raw, signs, strict=True))
    return found


class Encoder(dict):
    """Segment -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = self.library.pre_tokenizer.pre_tokenize_str
        # The character that stands for each byte, as the library itself shows it.
        self.split, self.tokenize = split, self.library.model.tokenize  # asked for once: each look-up in the library makes a new object
        self.alphabet = {byte: split(chr(byte))[0][0] for byte in range(128)} | {ord(c): sign for c, sign in _high_bytes(split).items()}
        self.blank = self.alphabet[32]
        letters = [chr(byte) for byte in range(128) if chr(byte).isalpha()]
        # Letters behind a blank are one pre-token, written as themselves, and hold no special string.
        self.plain = all(self.alphabet[ord(c)] == c for c in letters) and not any(s.strip(" ").isalpha() or not s.strip(" ") for s in self.special)
        parts = lambda text: [part for part, _ in split(text)]
        # A line break before letters and a run of signs behind them are pre-tokens of their own.
        self.parted = self.plain and parts("\na!?") == [self.alphabet[10], "a", "!?"] and parts(" a'_") == [self.blank + "a", "'_"]
        self.marks = {mark: self._ids(mark) for mark in ".,;:!?"}
        self.line, self.runs = self._ids("\n"), {}

    def __missing__(self, segment: str) -> bytes:
        if self.plain and segment.isalpha():
            value = self[segment] = self._letters(self.blank, segment)
            return value
        mark = self.marks.get(segment[-1:])
        if mark is not None and segment[:-1].isalpha():
            value = self[segment] = self[segment[:-1]] + mark  # the pre-tokenizer parts letters from marks
            return value
        shape = _SHAPE.fullmatch(segment) if self.parted else None
        if shape and shape[2].isalpha() and not any(s in segment for s in self.special):
            value = self.line + self._letters("", shape[2]) if shape[1] else self[shape[2]]
            value = self[segment] = value + self._run(shape[3])
            return value
        body = segment[1:] if segment[:1] == "\n" else segment
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Whole
        value = self[segment] = self._ids(segment if segment[0] == "\n" else " " + segment)
        return value

    def _letters(self, blank: str, letters: str) -> bytes:
        """Letters are one pre-token: its bytes in the vocabulary's alphabet."""
        signs = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [token.id for token in self.tokenize(blank + signs)]).tobytes()

    def _run(self, signs: str) -> bytes:
        if signs not in self.runs:
            if len(self.runs) >= RUNS:
                self.runs.clear()
            self.runs[signs] = self._ids(signs) if signs else b""
        return self.runs[signs]

    def _ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if text[0] == " " and text[1:].isalpha():  # letters behind a blank are one pre-token: its bytes in the vocabulary's alphabet
            parts = [text.encode().decode("latin-1").translate(self.alphabet)]
        else:
            parts = [part for part, _ in self.split(text)]
        tokenize = self.tokenize
        return array("I", [token.id for part in parts for token in tokenize(part)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or first[-1].isspace() or first[0].isspace():
                raise _Whole
            return self._first(first) + b"".join(map(self.__getitem__, rest))
        except _Whole:
            return self.whole(text)

    def _first(self, word: str) -> bytes:
        return self._ids(word)


def load(path: str) -> Encoder:
    """One vocabulary per worker process, with its memory."""
    return only(("token files", path), lambda: Encoder(path))


def encode_batches(path: str, end_id: int):
    """For ``mapInArrow`` over one range: doc_id and text to doc_id, before (ids of this range so far), size and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, end = load(path), 0, np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                runs = [encoder.encode(text) + end for text in batch.column(1).to_pylist()]
                if len(encoder) > REMEMBERED:
                    encoder.clear()
                offsets = np.cumsum([0, *(len(r) // 4 for r in runs)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(runs), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int32()), ids], ["doc_id", "before", "size", "ids"])
                before += int(offsets[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, codec: str = "none") -> None:
    """Writes the ids of all documents below ``path``; a repeated call needs another folder."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").drop("h", "at")
    encoded = ordered.mapInArrow(encode_batches(vocabulary, end_id), f"{id_type(docs)}, before long, size int, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE)}
    encoded.write.options(**options).option("compression", codec).orc(path)


def stored_schema(id_kind: str = "bigint") -> str:
    return f"doc_id {id_kind}, before long, size int, ids array<int>"


def read_token_files(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """doc_id, ids and start (ids of all documents before it) of every row."""
    # Spark pads task numbers to five digits, so files are ordered by the number and not by the name.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(stored_schema(id_kind)).orc(path).withColumn("file", number)
    ends = rows.groupBy("file").agg(F.max(F.col("before") + F.col("size")).alias("held")).collect()  # one number per file
    bases, seen = [], 0
    for row in sorted(ends, key=lambda r: r["file"]):
        bases.append((row["file"], seen))
        seen += row["held"]
    based = rows.join(small_side(spark.createDataFrame(bases, "file long, base long")), "file")
    return based.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int], id_kind: str = "bigint") -> DataFrame:
    """The rows of some documents; stripes without them are skipped by range and Bloom filter."""
    return spark.read.schema(stored_schema(id_kind)).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: doc_id, start and ids to doc_id, start, n_tokens and the crc32 of the ids' bytes."""
    release()
    for batch in batches:
        ids = batch.column(2)
        flat = np.asarray(ids.values).astype("<u4", copy=False).view(np.uint8)
        edges = np.asarray(ids.offsets)
        bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        sums = pa.array([zlib.crc32(flat[a * 4 : b * 4]) for a, b in bounds], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b - a for a, b in bounds], pa.int64()), sums], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    ship(rows.sparkSession)
    return rows.select("doc_id", "start", "ids").mapInArrow(checksum_batches, f"{id_type(rows)}, start long, n_tokens long, ids_crc32 long")
