"""Phrase collocations by counting in tries of word ids with burstable containers.

Phrases are counted one length after the other, a pass over all texts each. A phrase can only be frequent if the two phrases that it has
without its last and without its first word are, so a pass counts only places where both are flagged in a bitmap of the shorter frequent phrases.
The bitmap has 2**``CELL_BITS`` bits at any size of the corpus; phrases that share a cell are counted needlessly, never dropped.

A task numbers words as it meets them and counts phrases as sequences of these numbers in a trie: containers hold counts of sorted keys, each for a range of
prefixes. A container with more than ``BURST`` keys bursts: one that holds several words parts between words, one that holds a single word grows a level and
parts between second words, and so on. Beyond ``HELD`` keys in all, the largest subtrees leave the task whole, as runs in key order, and give their memory back.
Spark deals the runs by language and first two words, and merges each prefix partition.

Then every frequent phrase meets the counts of its parts by joins. Arithmetic is in decimals of 38 digits.

Defined results: a null text counts as empty and has no words; a null lang counts as ``und``; texts of any length are counted whole; repeated rows count each; phrases never
cross a piece or a document; equal scores and counts are in byte order of the phrase; empty tables give no rows; columns other than text and lang are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import release, ship, slices, stored, text_of

UNKNOWN = "und"
LONGEST = 5
CELL_BITS = 27
BURST = 1 << 16
HELD = 1 << 21
#: Words that a task numbers before all its subtrees leave and numbering starts anew; ids have ``ID_BITS`` bits.
ID_BITS, NUMBERED = 21, 400_000
SLICE = 4 << 20
_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: Upper case to lower, ends of pieces to a line end, tabs to spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls, one after the other, and the number of each word's piece."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    held = raw.buffers()[2]
    data = np.frombuffer((b"" if held is None else held[offsets[0] : offsets[-1]].to_pybytes()).translate(FOLD), np.uint8)
    begins = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]  # of the texts that are not empty
    ends = data == 10
    letters = ~ends & (data != 32)
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    first[begins] = letters[begins]
    at = np.flatnonzero(first)
    parts = np.cumsum(ends, dtype=np.int32)[at] + np.searchsorted(begins, at, side="right")
    starts = np.cumsum(letters, dtype=np.int64)[at] - 1
    packed = data[letters].tobytes()
    bounds = np.append(starts, len(packed)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(packed)]), parts


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def phrase_cells(hashes: np.ndarray, length: int) -> np.ndarray:
    """The cell of the phrase that begins at each word, for all places where one can."""
    count = max(0, len(hashes) - length + 1)
    mixed = np.zeros(count, np.uint64)
    for n in range(length):
        mixed = mixed * _MIX + hashes[n : n + count]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _END
    return (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def merged(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.lexsort((low, high)) if low.any() else np.argsort(high, kind="stable")
    high, low, counts = high[order], low[order], counts[order]
    fresh = np.ones(len(high), bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(fresh)
    return high[at], low[at], np.add.reduceat(counts, at) if len(at) else counts


class Container:
    """Counts of the keys of one range of prefixes."""

    def __init__(self, begin: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.begin, self.parts, self.packed = begin, parts, 0

    def held(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def pack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [merged(*(np.concatenate(column) for column in zip(*self.parts, strict=True)))]
        self.packed = self.held()
        return self.parts[0]


class Trie:
    """Counts of sequences of up to five word ids. A key's high part holds the first three ids, its low part the others."""

    def __init__(self):
        self.containers = [Container(0, [])]

    def held(self) -> int:
        return sum(c.held() for c in self.containers)

    def add(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> None:
        """Keys in order."""
        cuts = [0, *np.searchsorted(high, [c.begin for c in self.containers[1:]]).tolist(), len(high)]
        for container, start, end in list(zip(self.containers, cuts[:-1], cuts[1:], strict=True)):
            if end > start:
                container.parts.append((high[start:end], low[start:end], counts[start:end]))
                if container.held() > 2 * container.packed + BURST // 4:
                    container.pack()
                while container.packed > BURST and (container := self.burst(container)):
                    pass

    def burst(self, container: Container) -> Container | None:
        """Parts a container between two prefixes, the shortest that can; returns the larger of the two."""
        high, low, counts = container.pack()
        middle = int(high[len(high) // 2])
        for bits in (2 * ID_BITS, ID_BITS, 0):  # between words, second words, third words
            for cut in ((middle >> bits) << bits, ((middle >> bits) + 1) << bits):
                at = int(np.searchsorted(high, cut))
                if 0 < at < len(high):
                    container.parts = [(high[:at], low[:at], counts[:at])]
                    other = Container(cut, [(high[at:], low[at:], counts[at:])])
                    container.packed, other.packed = at, len(high) - at
                    insort(self.containers, other, key=lambda c: c.begin)
                    return max(container, other, key=lambda c: c.packed)
        return None

    def spill(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The largest subtrees, until at most ``most`` keys are left; each is a run in key order."""
        left = self.held()
        for container in sorted(self.containers, key=lambda c: -c.held()):
            if left <= most or not container.parts:
                break
            left -= container.held()
            yield container.pack()
            container.parts, container.packed = [], 0


class Counter:
    """What a task counts in one pass: phrases of ``length`` words where both shorter ones are flagged."""

    def __init__(self, length: int, bits: np.ndarray | None):
        self.length, self.bits, self.trie = length, bits, Trie()
        self.ids: dict[tuple[str, bytes], int] = {}
        self.totals: dict[str, int] = {}

    def flagged(self, cells: np.ndarray) -> np.ndarray:
        return (self.bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1

    def take(self, lang: str, texts: pa.Array) -> None:
        words, pieces = words_of(texts)
        count = len(words) - self.length + 1
        self.totals[lang] = self.totals.get(lang, 0) + len(words)
        if count <= 0:
            return
        coded = words.dictionary_encode()
        at, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        whole = pieces[: len(pieces) - self.length + 1] == pieces[self.length - 1 :]
        if self.length > 1:
            hashes = np.fromiter((word_hash(lang, w) for w in names), np.uint64, len(names))[at]
            known = self.flagged(phrase_cells(hashes, self.length - 1))
            whole &= known[:-1] & known[1:]
        places = np.flatnonzero(whole)
        if not len(places):
            return
        used = np.zeros(len(names), bool)
        for n in range(self.length):
            used[at[places + n]] = True
        number = np.zeros(len(names), np.int64)
        for n in np.flatnonzero(used).tolist():
            number[n] = self.ids.setdefault((lang, names[n]), len(self.ids))
        own = number[at]
        keys = [np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)]
        for n in range(self.length):
            keys[n // 3] |= own[places + n] << ((2 - n if n < 3 else 4 - n) * ID_BITS)
        self.trie.add(*merged(*keys, np.ones(len(places), np.int64)))

    def runs(self, most: int) -> Iterator[pa.RecordBatch]:
        if self.trie.held() <= most and len(self.ids) <= NUMBERED:
            return
        names = pa.array([word for _, word in self.ids], pa.binary()).cast(pa.string())
        langs = pa.array([lang for lang, _ in self.ids], pa.string())
        mask = (1 << ID_BITS) - 1
        for high, low, counts in self.trie.spill(0 if len(self.ids) > NUMBERED else most):
            columns = [(high >> 2 * ID_BITS) & mask, (high >> ID_BITS) & mask, high & mask, (low >> ID_BITS) & mask, low & mask][: self.length]
            parts = [names.take(pa.array(c)) for c in columns]
            phrase = parts[0] if self.length == 1 else pc.binary_join_element_wise(*parts, " ")
            for start in range(0, len(counts), 50_000):
                rows = [langs.take(pa.array(columns[0])), phrase, pa.array(counts)]
                yield pa.RecordBatch.from_arrays([r.slice(start, 50_000) for r in rows], ["lang", "phrase", "n"])
        if len(self.ids) > NUMBERED:
            self.ids.clear()


def count_batches(length: int, shared):
    """For ``mapInArrow``: lang and text to lang, phrase and count; in the first pass also a row per language with all its words and a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counter = Counter(length, None if shared is None else np.frombuffer(shared.value, np.uint8))
        for whole in batches:
            for batch in slices(whole, SLICE):
                langs = batch.column(0).dictionary_encode()
                codes = np.asarray(langs.indices)
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    counter.take(lang, batch.column(1).take(pa.array(np.flatnonzero(codes == code))))
                yield from counter.runs(HELD)
        yield from counter.runs(-1)
        if length == 1 and counter.totals:
            held = [pa.array(counter.totals, pa.string()), pa.nulls(len(counter.totals), pa.string()), pa.array(counter.totals.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(held, ["lang", "phrase", "n"])

    return run


def cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: lang and phrase to the phrase's cell."""
    for batch in batches:
        cells = []
        for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = phrase.encode().split(b" ")
            cells.append(int(phrase_cells(np.array([word_hash(lang, w) for w in words], np.uint64), len(words))[0]))
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["cell"])


def bitmap(frequent: DataFrame) -> bytes:
    """The flags of frequent phrases: 2**CELL_BITS bits, whatever their number."""
    cells = frequent.select("lang", "phrase").mapInArrow(cell_batches, "cell long")
    position = F.col("cell") + 1  # the functions count from one
    pages = cells.groupBy(F.bitmap_bucket_number(position).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))
    held, size = bytearray(1 << (CELL_BITS - 3)), 4096
    for row in pages.collect():  # at most 2**CELL_BITS bits in all
        held[(row["page"] - 1) * size : row["page"] * size] = row["bits"]
    return bytes(held)


def frequent_phrases(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to ``longest`` words with at least ``least`` occurrences; (lang, n): all words."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    shared, frames, totals = None, [], None
    for length in range(1, longest + 1):
        runs = texts.mapInArrow(count_batches(length, shared), "lang string, phrase string, n long")
        key = ["lang", "phrase"]
        if length > 2:  # a shorter phrase is its own prefix, and is sent once
            runs, key = runs.withColumn("head", F.substring_index("phrase", " ", 2)), ["lang", "head", "phrase"]
        summed = runs.repartition(*key[:2]).groupBy(*key).agg(F.sum("n").alias("a"))
        kept = stored(summed.filter(F.col("phrase").isNull() | (F.col("a") >= least)).select("lang", "phrase", "a"), f"phrases-{length}")
        if totals is None:
            totals = kept.filter(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
        own = kept.filter(F.col("phrase").isNotNull())
        frames.append(own.select("lang", "phrase", F.lit(length).alias("words"), "a"))
        if length < longest:
            shared = spark.sparkContext.broadcast(bitmap(own))
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def _part(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, covered: int = 100, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    A phrase goes where a longer one holds it and has ``covered`` per cent of its occurrences.
    """
    frequent, totals = frequent_phrases(docs, least, longest)
    candidates = frequent.filter("words > 1").withColumn("list", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(F.col("list"), F.lit(1), F.col("k")).alias("front"), _part(F.col("list"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    counted = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("held"))
    cuts = cuts.join(counted.select("lang", F.col("part").alias("front"), F.col("held").alias("l")), ["lang", "front"])
    cuts = cuts.join(counted.select("lang", F.col("part").alias("rest"), F.col("held").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumns({"whole": (F.lit(1000).cast("decimal(4,0)") * exact("a")).cast("decimal(19,0)") * exact("n"), "parted": exact("l") * exact("r")})
    scored = cuts.withColumn("score", F.expr("whole div parted"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a", "words")).alias("cut"))
    inner = candidates.filter("words > 2").select("lang", F.col("a").alias("around"), "words", "list").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", _part(F.col("list"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("around").alias("around"))
    kept = lowest.select("lang", "phrase", "cut.*").join(inner, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("around").isNull() | (exact("around") * 100 < exact("a") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
