"""Language of texts, with spans for mixed ones.

A token is cut into units: runs of letters of one script, and long runs into pieces (``PIECE`` letters in scripts written without blanks,
``LONGEST_RUN`` in others), so that what a language can lose grows with the letters of a token; most tokens are one unit.
Scripts narrow the candidates of a unit: only languages that write at least ``SCRIPT_SHARE`` of their letters in its script compete
for it. Each gets the unit's score from its character n-grams (naive Bayes, 1 to 4 letters with word ends, in 2**16 hashed cells),
as a loss against the best, at most ``MOST_LOST`` a unit. A Viterbi pass over the units of the whole text, with a penalty for each
switch, labels them. A text whose best single language loses no more than one penalty in all needs no pass: no path with a switch
can beat it. The other texts of a batch advance together, one unit at a time. The score counts the letters of units; spans count
tokens, and a token has the language of most of its letters.

The table is fitted on a bounded sample: at most about ``PER_LANGUAGE`` documents of each language, whole texts, drawn by a hash of
doc_id among the rows the caller allows. Its size is languages x 2**16 numbers at any scale of the input.

Defined results: ``und`` with score 0 and no spans for a null text or one without a letter; letters of scripts that no learned language uses give
no evidence, and a text of nothing else gets the language with most documents and score 0; equal scores go to the language that
sorts first; with no learned language everything is ``und``; repeated rows are judged alike, row by row; an empty table gives no rows;
columns other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import id_type, only, release, ship, slices

PER_LANGUAGE = 4_000
CELL_BITS = 16
CELLS = 1 << CELL_BITS
LONGEST_GRAM = 4
SCRIPT_SHARE = 0.01
MOST_LOST = 5.0
#: Letters of a unit at most, in scripts without blanks between words and in the others.
PIECE, LONGEST_RUN = 4, 40
UNSPACED = {"han", "kana", "thai", "lao", "tibetan", "myanmar", "khmer"}
SWITCH = 15.0
#: Bytes of tokens and units that a worker remembers, about; and of text that it reads at a time, which bounds what can come on top.
REMEMBERED = 64 << 20
SLICE = 2 << 20
#: Bytes that a dictionary entry takes besides its text, about.
ENTRY = 160
#: Distinct words that a task of the fit counts before it folds them into cells, over all languages.
COUNTED = 200_000
#: Units that advance together in one pass.
PASS_WORDS = 1_000_000
UNKNOWN = "und"

# First code points of Unicode blocks that begin another script, and that script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFDD, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [start for start, _ in SCRIPTS]


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def units_of(word: str) -> list[tuple[str, str]]:
    """(unit, script) of the letters of a token, in order."""
    if len(word) <= LONGEST_RUN and word.isascii():
        return [(word, "latin")]
    found = []
    for script, run in groupby(word, script_of):
        letters, most = "".join(run), PIECE if script in UNSPACED else LONGEST_RUN
        found += [(letters[at : at + most], script) for at in range(0, len(letters), most)]
    return found


def cells_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of many words, over bytes of UTF-8, and the number of each n-gram's word."""
    raw = [f"^{word}$".encode() for word in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    letters = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # letters from here to the word's end
    cells, owners = [], []
    code = np.zeros(len(letters), np.uint32)
    for size in range(1, LONGEST_GRAM + 1):
        here = left >= size
        code = code[: len(letters) - size + 1] * np.uint32(257) + letters[size - 1 :]
        at = here[: len(code)]
        mixed = (code[at] ^ (code[at] >> np.uint32(15)) ^ np.uint32(size * 0x9E37)) * np.uint32(0x85EBCA6B)
        cells.append((mixed >> np.uint32(32 - CELL_BITS)).astype(np.int64))
        owners.append(owner[: len(code)][at])
    return np.concatenate(cells), np.concatenate(owners)


@dataclass
class Model:
    """languages in order, prior documents, gram[cell, language] log-probabilities, scripts[script] mask of languages."""

    languages: list[str]
    documents: list[int]
    gram: np.ndarray
    scripts: dict[str, np.ndarray]
    key: str


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: lang and text to (lang, cell, count) and (lang, script, letters), summed over the task."""
    release()
    words: dict[str, Counter] = {}
    cells: dict[str, np.ndarray] = {}
    scripts: dict[str, Counter] = {}

    def fold(lang: str) -> None:
        held = cells.setdefault(lang, np.zeros(CELLS, np.int64))
        seen = scripts.setdefault(lang, Counter())
        counted: Counter = Counter()
        for token, n in words.pop(lang).items():
            if word := letters_of(token):
                for unit, script in units_of(word):
                    seen[script] += n * len(unit)
                    counted[unit] += n
        if counted:
            grams, owners = cells_of(list(counted))
            weights = np.fromiter(counted.values(), np.int64, len(counted))
            held += np.bincount(grams, weights[owners], CELLS).astype(np.int64)

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > COUNTED:
                for full in list(words):
                    fold(full)
    for lang in list(words):
        fold(lang)
    names = ["lang", "cell", "script", "n"]
    for lang, held in cells.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.nulls(len(at), pa.string()), pa.array(held[at], pa.int64())], names)
        seen = scripts[lang]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names)


def fit(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE) -> Model:
    """The table, from rows of ``docs`` where ``allowed`` holds and neither text nor lang is null."""
    ship(docs.sparkSession)
    rows = docs.filter(allowed & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros((CELLS, 0), np.float32), {}, uuid.uuid4().hex)
    # A language with n rows keeps those whose hash is in the first per_language / n of its range.
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, per_language / n) * (1 << 30))) for lang, n in sizes.items()], "lang string, share long")
    drawn = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(20240601)), F.lit(1 << 30))).join(F.broadcast(shares), "lang")
    counted = drawn.filter("place < share").select("lang", "text").mapInArrow(count_batches, "lang string, cell long, script string, n long")
    summed = counted.groupBy("lang", "cell", "script").agg(F.sum("n").alias("n")).collect()  # at most CELLS and the scripts per language
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((CELLS, len(languages)), 0.1)
    scripts: dict[str, np.ndarray] = {}
    for row in summed:
        if row["script"] is None:
            counts[row["cell"], at[row["lang"]]] += row["n"]
        else:
            scripts.setdefault(row["script"], np.zeros(len(languages)))[at[row["lang"]]] = row["n"]
    letters = sum(scripts.values()) if scripts else np.ones(len(languages))
    masks = {script: n >= SCRIPT_SHARE * np.maximum(letters, 1) for script, n in scripts.items()}
    gram = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(languages, [sizes[lang] for lang in languages], gram, masks, uuid.uuid4().hex)


class Words(dict):
    """Token -> row of ``loss`` (per language) and ``weight`` (letters) of its unit; row 0 stands for tokens without letters.

    A token of several units has a negative value -n, and their rows are ``parts[n]``.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.size = model, len(model.languages)
        self.start()

    def start(self) -> None:
        self.clear()
        self.used, self.held, self.rows, self.parts = 1, 0, {}, [np.zeros(0, np.int64)]  # held: bytes, about
        self.loss, self.weight, self.lettered = np.zeros((1, self.size), np.float32), np.zeros(1, np.int32), np.zeros(1, bool)

    def learn(self, tokens: set[str]) -> None:
        """Adds the tokens that are not known yet, all at once."""
        fresh = sorted(tokens.difference(self))
        words = {token: word for token in fresh if (word := letters_of(token))}
        self.update(dict.fromkeys(fresh, 0))
        self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
        added: dict[str, str] = {}
        for token, word in words.items():
            units = units_of(word)
            for unit, script in units:
                if unit not in self.rows:
                    self.rows[unit] = self.used + len(added)
                    added[unit] = script
            if len(units) == 1:
                self[token] = self.rows[units[0][0]]
            else:
                self[token] = -len(self.parts)
                self.parts.append(np.fromiter((self.rows[unit] for unit, _ in units), np.int64, len(units)))
                self.held += 8 * len(units) + ENTRY
        if not added:
            return
        plain, scripts = list(added), list(added.values())
        masks = {s: m for s in set(scripts) if (m := self.model.scripts.get(s)) is not None and m.any()}
        known = np.array([s in masks for s in scripts])
        loss, weight = np.zeros((len(plain), self.size), np.float32), np.zeros(len(plain), np.int32)
        if known.any():
            cells, owners = cells_of(plain)
            score = np.stack([np.bincount(owners, self.model.gram[cells, n], len(plain)) for n in range(self.size)], axis=1)
            mask = np.array([masks.get(s, np.ones(self.size, bool)) for s in scripts])
            best = np.where(mask, score, -np.inf).max(axis=1)
            loss[:] = np.where(mask, np.minimum(best[:, None] - score, MOST_LOST), MOST_LOST) * known[:, None]
            weight[:] = np.fromiter(map(len, plain), np.int64, len(plain)) * known
        self.used += len(plain)
        self.held += sum(map(len, plain)) + (ENTRY + 4 * self.size + 5) * len(plain)
        self.loss, self.weight = np.concatenate([self.loss, loss]), np.concatenate([self.weight, weight])
        self.lettered = np.concatenate([self.lettered, np.ones(len(plain), bool)])


def viterbi(loss: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The cheapest language of every unit; ``loss`` holds the units of several texts one after the other."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    size = loss.shape[1]
    cost = loss[starts].astype(np.float64)
    came = np.zeros(loss.shape, np.int8)  # the language before this word, if this word has that language
    own = np.arange(size, dtype=np.int8)
    steps = int(sorted_lengths[0])
    alive = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")  # texts with more than t words
    for t in range(1, steps):
        n = alive[t]
        held = cost[:n]
        best = held.argmin(axis=1)
        switched = held[np.arange(n), best] + penalty
        stay = held <= switched[:, None]
        at = starts[:n] + t
        came[at] = np.where(stay, own, best[:, None])
        cost[:n] = np.where(stay, held, switched[:, None]) + loss[at]
    labels = np.zeros(len(loss), np.int8)
    current = cost.argmin(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        current[:n] = came[at, current[:n]]
    return labels


def label_texts(words: Words, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans as first word, number of words, language) of each text."""
    model = words.model
    if words.held > REMEMBERED:
        words.start()
    tokens = [text.split() if text else [] for text in texts]
    words.learn(set().union(*tokens))
    found: list[tuple[str, float, list[tuple[int, int, str]]]] = []
    prior = max(range(words.size), key=lambda i: model.documents[i]) if words.size else 0
    rows = [np.fromiter(map(words.__getitem__, t), np.int64, len(t)) for t in tokens]
    sizes = {}  # of texts with a token of several units: the units of each token
    for n, row in enumerate(rows):
        if len(row) and row.min() < 0:
            parts = [words.parts[-r] if r < 0 else np.array([r]) for r in row.tolist()]
            sizes[n], rows[n] = np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
    passes, waiting = [], 0
    for n, row in enumerate(rows):
        total = words.loss[row].sum(axis=0) if len(row) else np.zeros(words.size)
        weight = int(words.weight[row].sum())
        if not words.size or not words.lettered[row].any():
            found.append((UNKNOWN, 0.0, []))
        elif not weight:
            found.append((model.languages[prior], 0.0, [(0, len(tokens[n]), model.languages[prior])]))
        elif total.min() <= SWITCH:
            lang = model.languages[int(total.argmin())]
            found.append((lang, 1.0, [(0, len(tokens[n]), lang)]))
        else:
            found.append((UNKNOWN, 0.0, []))
            if not passes or waiting + len(row) > PASS_WORDS:
                passes.append([])
                waiting = 0
            passes[-1].append(n)
            waiting += len(row)
    for group in passes:
        lengths = np.array([len(rows[n]) for n in group])
        flat = np.concatenate([rows[n] for n in group])
        labels = viterbi(words.loss[flat], lengths)
        ends = np.cumsum(lengths)
        for n, end, length in zip(group, ends.tolist(), lengths.tolist(), strict=True):
            own, weight = labels[end - length : end], words.weight[rows[n]]
            share = np.bincount(own, weight, words.size)
            best = int(share.argmax())
            if n in sizes:
                owner = np.repeat(np.arange(len(sizes[n])), sizes[n])
                letters = np.bincount(owner * words.size + own, weight, len(sizes[n]) * words.size).reshape(-1, words.size)
                first = own[np.cumsum(sizes[n]) - sizes[n]]
                own = np.where(letters.any(axis=1), letters.argmax(axis=1), first)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            spans = [(a, b - a, model.languages[own[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            found[n] = (model.languages[best], float(share[best] / share.sum()), spans)
    return found


def label_batches(shared, passed: int):
    """For ``mapInArrow``: ``passed`` columns and a text to those columns, lang_pred, score and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = only(("language", shared.value.key), lambda: Words(shared.value))
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for whole in batches:
            for batch in slices(whole, SLICE, passed):
                found = label_texts(words, batch.column(passed).to_pylist())
                spans = pa.array([[{"first": a, "words": n, "lang": lang} for a, n, lang in s] for _, _, s in found], spans_type)
                made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
                yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *made], [*batch.schema.names[:passed], "lang_pred", "score", "spans"])

    return run


SPANS = "array<struct<first: int, words: int, lang: string>>"


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language) and spans of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(label_batches(shared, 1), f"{id_type(docs)}, lang_pred string, score double, spans {SPANS}")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents with a language that holds at least ``least`` of the letters, every column as it was."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("whole"), docs["text"].alias("text"))
    judged = packed.mapInArrow(label_batches(shared, 1), f"whole {packed.schema['whole'].dataType.simpleString()}, lang_pred string, score double, spans {SPANS}")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("whole.*")
