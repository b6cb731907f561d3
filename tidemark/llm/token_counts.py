"""Token counts of whole texts; huge documents are counted in overlapping chunks.

A text of more than ``CHUNK`` characters is cut into windows of that many characters and an overlap into the next window. Windows are
spread over the cluster and encoded with offsets. Two neighbours are spliced at the first place of their overlap that is proven stable
(the characters on its two sides stand next to each other in no piece of the vocabulary, so no merge can ever cross it) and where both
encodings have a token boundary. Where an overlap holds no such place the document is cut again with an overlap twice as wide, until
its windows align or one window holds it all. Each window then counts its tokens between its two splices.

For ``.model`` files the sentencepiece library counts, for ``.json`` files the tokenizers library; both without begin, end or added
special tokens, special strings inside a text as the library's default has it. Windows are used where a proof of stable places is known
(merge-type pieces); a ``.json`` vocabulary is counted on whole texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; no text is cut short; repeated rows are counted alike, row by row; an
empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import id_type, release, ship, slices, stored, text_of

CHUNK = 32_768
OVERLAP = 256
SPACE = "▁"
WINDOW = "sha string, at long, overlap long, last boolean, text string"
COUNTED = "sha string, at long, left_edge long, right_edge long, n_tokens long, last boolean"


class Pieces:
    """The sentencepiece library with the pairs of characters that its pieces hold side by side."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not self.library.is_byte(i)]
        self.inside = {a + b for n in names for a, b in zip(n, n[1:], strict=False)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)] if texts else []

    def stable(self, before: str, after: str) -> bool:
        return before.replace(" ", SPACE) + after.replace(" ", SPACE) not in self.inside

    def edges(self, text: str) -> np.ndarray:
        """Offsets in characters where a token of ``text`` starts."""
        starts = [p.begin for p in self.library.encode(text, return_type="proto").pieces]  # in bytes of UTF-8
        raw = np.frombuffer(text.encode(), np.uint8)
        characters = np.cumsum((raw & 0xC0) != 0x80)  # characters that have begun up to each byte
        return characters[np.asarray(starts, np.int64)] - 1 if starts else np.zeros(0, np.int64)


class Json:
    """The tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)] if texts else []


@lru_cache(maxsize=2)
def load(path: str) -> Pieces | Json:
    return Pieces(path) if path.endswith(".model") else Json(path)


def count_batches(path: str):
    """For ``mapInArrow``: doc_id, n_bytes and text to doc_id, n_bytes and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocabulary = load(path)
        for whole in batches:
            for batch in slices(whole, column=2):
                counted = pa.array(vocabulary.counts(batch.column(2).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], counted], ["doc_id", "n_bytes", "n_tokens"])

    return run


def cut_batches(chunk: int):
    """For ``mapInArrow``: sha, overlap and text to windows; each holds ``chunk`` characters and the overlap behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sha", "at", "overlap", "last", "text"]
        for batch in batches:
            for sha, overlap, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step = max(chunk, overlap)
                for at in range(0, len(text), step):
                    last = at + step >= len(text)
                    row = (sha, at, overlap, last, text[at : at + step + overlap])
                    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return run


def splice(vocabulary: Pieces, text: str, start: int, end: int, edges: set[int]) -> int:
    """The first place in text[start:end] that is stable and a token boundary; -1 if there is none."""
    for place in range(max(start, 1), min(end, len(text))):
        if place in edges and vocabulary.stable(text[place - 1], text[place]):
            return place
    return -1


def window_batches(path: str, chunk: int):
    """For ``mapInArrow``: windows to their splices (in characters of the document; -1: none found) and the tokens between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocabulary = load(path)
        for batch in batches:
            rows = []
            for sha, at, overlap, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step = max(chunk, overlap)
                edges = vocabulary.edges(text)
                held = set(edges.tolist())
                # The first character of an overlap can't be a splice: what stands before it is not in the right-hand window.
                left = splice(vocabulary, text, 1, overlap, held) if at else 0
                right = len(text) if last else splice(vocabulary, text, step + 1, step + overlap, held)
                counted = int(((edges >= left) & (edges < right)).sum()) if left >= 0 and right >= 0 else -1
                rows.append((sha, at, at + left if left >= 0 else -1, at + right if right >= 0 else -1, counted, last))
            names = ["sha", "at", "left_edge", "right_edge", "n_tokens", "last"]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types, strict=True)], names)

    return run


def huge_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """sha and n_tokens of distinct huge texts (sha, text)."""
    done, waiting = None, texts.select("sha", F.lit(overlap).cast("long").alias("overlap"), "text")
    while True:
        windows = waiting.mapInArrow(cut_batches(chunk), WINDOW)
        spread = windows.repartition("sha", "at")
        counted = stored(spread.mapInArrow(window_batches(path, chunk), COUNTED), "count-windows")
        # A splice is named by both of its windows; they must name the same place.
        left = counted.filter("at > 0").select("sha", F.col("left_edge").alias("edge"))
        right = counted.filter("not last").select("sha", F.col("right_edge").alias("edge"))
        places = left.unionByName(right).groupBy("sha", "edge").agg(F.count(F.lit(1)).alias("named"))
        apart = places.groupBy("sha").agg(F.max(((F.col("edge") < 0) | (F.col("named") != 2)).cast("int")).alias("apart"))
        sums = counted.groupBy("sha").agg(F.sum("n_tokens").alias("n_tokens")).join(apart, "sha", "left")
        sums = stored(sums.select("sha", "n_tokens", (F.coalesce("apart", F.lit(0)) == 0).alias("aligned")), "count-sums")
        aligned = sums.filter("aligned").select("sha", "n_tokens")
        done = aligned if done is None else done.unionByName(aligned)
        if sums.filter("not aligned").isEmpty():
            return done
        overlap *= 2
        failed = sums.filter("not aligned").select("sha")
        waiting = texts.join(failed, "sha", "left_semi").select("sha", F.lit(overlap).cast("long").alias("overlap"), "text")


def counted(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = f"{id_type(docs)}, n_bytes long, n_tokens long"
    if not path.endswith(".model"):
        return rows.mapInArrow(count_batches(path), schema)
    is_huge = F.char_length("text") > chunk
    small = rows.filter(~is_huge).mapInArrow(count_batches(path), schema)
    huge = rows.filter(is_huge).withColumn("sha", F.sha2("text", 256))
    counts = huge_counts(huge.select("sha", "text").dropDuplicates(["sha"]), path, chunk, overlap)
    return small.unionByName(huge.select("doc_id", "n_bytes", "sha").join(counts, "sha").select("doc_id", "n_bytes", "n_tokens"))
