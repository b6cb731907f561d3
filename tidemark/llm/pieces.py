"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda holds the adjacent pairs of symbols that form a piece; the best pair (highest score, then leftmost) is merged, and
its new neighbours join the agenda, until nothing is left to merge. Symbols without a piece become their bytes. The new segments of a batch
are merged side by side, a row of an array each.

No piece has a meta space after another character, so no merge crosses from a word into the next; neither does one cross a character
that occurs in no longer piece (such as a line break). The texts of a batch are cut at these places together, in columns: each distinct
segment is looked up once, and ids and the pieces they stand for are gathered as arrays. What an agenda made of a segment is
remembered, so each distinct segment is encoded once per worker while its memory (about ``REMEMBERED`` segments, ids and bytes) lasts. Every whole text
is checked in its Arrow batch against the sentencepiece library, ids and decoded text; a difference means that the vocabulary is not
of the merge type, and raises.

Defined results: a null text counts as empty and has no tokens; a text of any length is encoded whole; repeated rows are encoded
alike, row by row; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_type, only, ship, slices, text_of

SPACE = "▁"
REMEMBERED = 250_000
#: Bytes of text that a worker encodes at a time.
SLICE = 6 << 20
#: Symbols up to which the agenda is a plain list, searched whole; beyond, it is a heap.
SHORT = 24
#: Characters of a segment up to which it is merged side by side with others.
WIDE = 32
NEVER = float("inf")
SPACE_BYTES = SPACE.encode()
#: What no word starts with.
NO_WORD = ("", "\n")
#: More than the lines of segments side by side.
LINES = np.int32(2 * WIDE)
#: The rank of a pair that joins to no piece.
NO_PAIR = np.int32(2**31 - 1)


class Memory(dict):
    """Segment -> (its ids as little-endian 32-bit integers, the bytes they stand for)."""

    def __init__(self, make, shown: list[bytes]):
        super().__init__()
        self.make, self.shown = make, shown

    def __missing__(self, key: str) -> tuple[bytes, bytes]:
        ids = self.make(key)
        value = self[key] = (array("i", ids).tobytes(), b"".join(map(self.shown.__getitem__, ids)))
        return value


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        self.names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.unknown = library.unk_id()
        self.byte_ids = {int(n[1:-1], 16): i for i, n in enumerate(self.names) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        special = lambda i: library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)
        self.ids = {n: i for i, n in enumerate(self.names) if not special(i)}
        self.cost = {n: -library.get_score(i) for n, i in self.ids.items()}
        # The piece of each code point that is one.
        self.point_ids = np.full(0x110000, -1, np.int32)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.point_ids[ord(name)] = i
        self.hidden = {i for i in range(len(self.names)) if library.is_control(i)}
        joined = {c for n in self.ids if len(n) > 1 for c in n}
        self.crossed = any(SPACE in n.lstrip(SPACE) for n in self.ids)
        self.alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        self.lone = np.isin(np.arange(256), np.frombuffer(self.alone.encode(), np.uint8))
        # What each id stands for in a decoded text.
        self.shown = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.hidden else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.shown_array = pa.array(self.shown, pa.large_binary())
        self.memory = Memory(lambda key: self.merged(self.segment_of(key)), self.shown)
        self.segments = Memory(self.merged, self.shown)
        # Pairs of pieces that join to a piece, for agendas of many segments side by side.
        pairs = sorted((self.ids[n[:at]] * len(self.names) + self.ids[n[at:]], i) for n, i in self.ids.items() for at in range(1, len(n)) if n[:at] in self.ids and n[at:] in self.ids)
        self.pair_keys = np.array([key for key, _ in pairs] or [-1], np.int64)
        self.pair_joined = np.array([i for _, i in pairs] or [0], np.int64)
        costs = np.array([self.cost[self.names[i]] for _, i in pairs] or [NEVER])
        self.pair_ranks = np.unique(costs, return_inverse=True)[1].astype(np.int32)
        self.place_pairs()

    @staticmethod
    def segment_of(word: str) -> str:
        return word if word[0] == "\n" else SPACE + word

    def pair_slots(self, keys: np.ndarray, step: int) -> np.ndarray:
        """Where the pairs are in a table of places; keys are spread by a multiplier."""
        return ((keys.view(np.uint64) * self.multipliers[step]) >> self.shift).view(np.int64)

    def place_pairs(self) -> None:
        """Two tables of places in ``pair_keys`` (-1: empty): pairs that meet another one in the first are alone in the second."""
        bits = max(4, (16 * len(self.pair_keys)).bit_length())
        self.shift, rng = np.uint64(64 - bits), np.random.default_rng(3)
        while True:
            self.multipliers = rng.integers(1 << 62, 1 << 63, 2, np.uint64) | np.uint64(1)
            self.places, left = [], np.arange(len(self.pair_keys))
            for step in range(2):
                table, at = np.full(1 << bits, -1, np.int32), self.pair_slots(self.pair_keys[left], step)
                table[at] = left
                self.places.append(table)
                left = left[table[at] != left]
            if not len(left):
                return

    def pair_costs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the cost and joined piece of pairs; NO_PAIR for those that join to none."""
        keys = left * len(self.names) + right
        at = self.places[0][self.pair_slots(keys, 0)]
        met = np.nonzero((at >= 0) & (self.pair_keys[at] != keys))
        at[met] = self.places[1][self.pair_slots(keys[met], 1)]
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], NO_PAIR), self.pair_joined[at]

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Agendas of many segments side by side, a row each (ids of their characters, -1 behind the end); dead symbols become -1.

        The segments stand in columns here, between two lines of -1. The agenda holds each pair's rank and, behind it, the line of its left symbol,
        so a column's least entry is its best pair, the leftmost of equal ones; each turn merges that of all columns. Places count through all lines.
        """
        count, width = rows.shape
        symbols = np.full((width + 2, count), -1, np.int64)
        symbols[1:-1] = rows.T
        agenda, joined = np.full(symbols.shape, NO_PAIR), np.zeros(symbols.shape, np.int64)
        lines = np.arange(width + 2, dtype=np.int32)[:, None]
        ranks, joined[1:-1] = self.pair_costs(symbols[1:-1], symbols[2:])
        agenda[1:-1] = np.where(ranks == NO_PAIR, NO_PAIR, ranks * LINES + lines[1:-1])
        after = np.arange(count, symbols.size + count)
        before = after - 2 * count
        symbol, entry, piece = symbols.reshape(-1), agenda.reshape(-1), joined.reshape(-1)
        while True:
            best = agenda.min(axis=0)
            going = np.flatnonzero(best != NO_PAIR)
            if not len(going):
                return symbols[1:-1].T
            at = (best[going] % LINES).astype(np.int64) * count + going
            gone = after[at]
            merged = symbol[at] = piece[at]
            symbol[gone], entry[gone] = -1, NO_PAIR
            follows = after[at] = after[gone]
            before[follows] = at
            ahead = before[at]
            for left, pair in ((at, (merged, symbol[follows])), (ahead, (symbol[ahead], merged))):
                ranks, piece[left] = self.pair_costs(*pair)
                entry[left] = np.where(ranks == NO_PAIR, NO_PAIR, ranks * LINES + (left // count).astype(np.int32))

    def learn(self, memory: Memory, words: set[str]) -> None:
        """Adds the words that ``memory`` has not met; those with a character that is no piece, and long ones, go through an agenda of their own."""
        fresh = list(words.difference(memory))
        segments = [w if w[0] == "\n" else SPACE + w for w in fresh] if memory is self.memory else fresh
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        narrow = np.flatnonzero((lengths > 0) & (lengths <= WIDE))
        if len(narrow) < len(fresh):
            fresh, segments, lengths = [fresh[i] for i in narrow.tolist()], [segments[i] for i in narrow.tolist()], lengths[narrow]
        if not fresh:
            return
        letters = "".join(segments)
        points = np.frombuffer(letters.encode("utf-32-le"), "<u4")
        symbols, starts = self.point_ids[points], np.cumsum(lengths) - lengths
        known = np.minimum.reduceat(symbols, starts) >= 0
        # The bytes that the segments stand for, cut from those of all.
        shown = letters.replace(SPACE, " ").encode()
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        sizes[points == ord(SPACE)] = 1
        sizes = np.add.reduceat(sizes, starts)
        shown_ends = np.cumsum(sizes)
        widths = -(-lengths // 4) * 4
        for width in np.unique(widths[known]).tolist():
            rows = np.flatnonzero(known & (widths == width))
            inside = np.arange(width) < lengths[rows, None]
            table = np.full((len(rows), width), -1, np.int64)
            table[inside] = symbols[(starts[rows, None] + np.arange(width))[inside]]
            merged = self.merge_rows(table)
            ids = merged[merged >= 0].astype("<i4").tobytes()
            ends = 4 * np.cumsum((merged >= 0).sum(axis=1))
            found = [ids[start:end] for start, end in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            bodies = [shown[start:end] for start, end in zip((shown_ends - sizes)[rows].tolist(), shown_ends[rows].tolist(), strict=True)]
            memory.update(zip([fresh[i] for i in rows.tolist()], zip(found, bodies, strict=True), strict=True))

    def merged(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda."""
        symbols = self.merge_few(list(segment)) if len(segment) <= SHORT else self.merge_many(list(segment))
        found: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                found.append(self.ids[symbol])
            elif self.byte_ids:
                found += [self.byte_ids[b] for b in symbol.encode()]
            else:
                found.append(self.unknown)
        return found

    def merge_few(self, symbols: list[str]) -> list[str]:
        """The agenda as a list: the cost of each adjacent pair in its place, so the first of equal ones is the leftmost."""
        cost = self.cost.get
        agenda = [cost(left + right, NEVER) for left, right in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != NEVER:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + symbols[at], NEVER)
            if at < len(agenda):
                agenda[at] = cost(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def merge_many(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap."""
        count, cost = len(symbols), self.cost
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        agenda = []
        for left in range(count - 1):
            pair = symbols[left] + symbols[left + 1]
            if pair in cost:
                agenda.append((cost[pair], left, left + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following < count:
                before[following] = left
                wider = pair + symbols[following]
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], left, following, wider))
            if before[left] >= 0:
                wider = symbols[before[left]] + pair
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], before[left], left, wider))
        return list(filter(None, symbols))

    def cut(self, texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
        """The distinct segments of whole texts, which one each segment of theirs is, and where each text's segments end among these."""
        plain = pa.array(self.library.normalize(texts) if texts else [], pa.large_string())
        _, edges, letters = plain.buffers()
        edges = np.frombuffer(edges, np.int64, len(texts) + 1)
        points = np.frombuffer(letters or b"", np.uint8, int(edges[-1]))
        starting = np.zeros(len(points) + 1, bool)
        if not self.crossed:
            lone = self.lone[points]
            starting[:-1] |= lone
            starting[1:] |= lone
            spaces = np.flatnonzero(points == SPACE_BYTES[0])
            for n, value in enumerate(SPACE_BYTES):
                spaces = spaces[points[spaces + n] == value]
            first = np.diff(spaces, prepend=-2 * len(SPACE_BYTES)) != len(SPACE_BYTES)  # of those in a row
            starting[spaces[first]] = True
        starting[edges] = True
        starts = np.flatnonzero(starting)
        segments = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64, copy=False)), letters])
        found = segments.dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices, np.searchsorted(starts, edges)

    def memory_of(self, segment: str) -> tuple[Memory, str]:
        """The memory that knows a segment, and its name there."""
        return (self.memory, segment[1:]) if segment[0] == SPACE and segment[1:2] not in NO_WORD else (self.segments, segment)

    def both(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian 32-bit integers) and decoded texts of whole texts."""
        segments, places, edges = self.cut(texts)
        held = list(map(self.memory_of, segments))
        for memory in (self.memory, self.segments):
            self.learn(memory, {name for at, name in held if at is memory})
        known = pa.array([memory[name][0] for memory, name in held], pa.large_binary()).take(places)
        _, ends, ids = known.buffers()
        ends, ids = np.frombuffer(ends, np.int64, len(known) + 1)[edges], np.frombuffer(ids or b"", np.uint8)
        whole = ids[: ends[-1]].view("<i4")
        _, places, shown = (said := self.shown_array.take(pa.array(whole))).buffers()
        places, shown = np.frombuffer(places, np.int64, len(said) + 1)[ends // 4].tolist(), memoryview(shown or b"")
        ends = ends.tolist()
        return [ids[start:end].tobytes() for start, end in pairwise(ends)], [self.read(bytes(shown[start:end])) for start, end in pairwise(places)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        segments, places, _ = self.cut([text])
        known = [memory[name][0] for memory, name in map(self.memory_of, segments)]
        return b"".join([known[at] for at in places.to_pylist()])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, without the space put before the first word."""
        return self.read(b"".join(map(self.shown.__getitem__, ids)))

    @staticmethod
    def read(shown: bytes) -> str:
        text = shown.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def forget(self) -> None:
        for memory in (self.memory, self.segments):
            if len(memory) > REMEMBERED or self.crossed:
                memory.clear()

    def check(self, texts: list[str], ids: list[bytes], decoded: list[str]) -> None:
        """Compares whole texts of a batch with the library's ids and decoded texts."""
        theirs = self.library.encode(texts, num_threads=1, return_type="numpy") if texts else []
        if list(map(len, ids)) != [4 * len(t) for t in theirs] or b"".join(ids) != b"".join([t.astype("<i4", copy=False).tobytes() for t in theirs]):
            text = next(t for t, own, other in zip(texts, ids, theirs, strict=True) if own != other.astype("<i4").tobytes())
            raise ValueError(f"the agenda and the sentencepiece library differ; is the vocabulary of the merge type? Text: {text[:200]!r}")
        shown = self.library.decode(theirs, num_threads=1) if texts else []
        if decoded != shown:
            text = next(t for t, own, other in zip(texts, decoded, shown, strict=True) if own != other)
            raise ValueError(f"own decoding and the sentencepiece library's differ. Text: {text[:200]!r}")


@contextmanager
def uncollected():
    """Without searches for cycles: what a batch adds to a memory holds none, and each search would walk all of it."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def load(path: str) -> Pieces:
    """One vocabulary per worker process, with its memory."""
    return only(("pieces", path), lambda: Pieces(path))


def encode_batches(path: str):
    """For ``mapInArrow``: doc_id and text to doc_id, ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for whole in batches:
            for batch in slices(whole, SLICE):
                texts = batch.column(1).to_pylist()
                with uncollected():
                    made, decoded = pieces.both(texts)
                    pieces.check(texts, made, decoded)
                pieces.forget()
                offsets = np.cumsum([0, *(len(ids) // 4 for ids in made)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document."""
    ship(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(encode_batches(path), f"{id_type(docs)}, ids array<int>, decoded string")
