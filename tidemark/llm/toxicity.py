"""Toxicity of texts by a weighted finite-state pattern grammar.

A clause is read as symbols: insult, threat, target, negation, report and other words. Four transducers are composed into one machine:
reported speech (an insult behind "said" is quoted), negation (an insult within three words of "not" is denied), target (an insult
within five words of "you" is aimed) and the pattern weights. The machine reads a clause once; its output is the clause's score, the sum over its matched patterns of the
word's own weight times the pattern's. A text's evidence is the sum over its clauses, and a logistic curve turns that into 0 to 1.

The grammar's fixed words are listed below. Further insult stems are learned from labelled documents: prefixes of 4 to 6 letters and whole
words that occur far more often under label 1. The labelled sample is bounded: at most about ``SAMPLE`` rows of each label, drawn by a
hash of doc_id, whole texts; the stems and the curve come from it alone, so their size doesn't grow with the input.

Defined results: a null or empty text has evidence 0 and the score of the curve there; repeated rows are judged alike, row by row; repeated label rows
count once, contradicting ones as toxic; without labels of both kinds the fixed words and the default curve are used; equal weights
are ordered by the stem; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import id_type, only, release, ship, slices, stored

SAMPLE = 10_000
STEM = (4, 5, 6)
LEAST_DOCS = 4
LEAST_ODDS = 3.0
#: Different words a learned stem must follow; a chance word in copies of one text always follows the same.
LEAST_CONTEXTS = 10
REMEMBERED = 400_000

OTHER, TARGET, DENIAL, REPORT, INSULT, THREAT = "other target denial report insult threat".split()
AIMED, QUOTED, DENIED = "aimed", "quoted", "denied"

# Words of the grammar in the languages it knows.
TARGETS = set("you your yours yourself u he she they him her them du dich dir dein ihr euch sie tu te toi ton vous votre tú ti usted ustedes vosotros".split())
DENIALS = set("not no never nor isn't aren't wasn't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split())
REPORTS = set("said says say saying wrote writes called claims claimed reported quoted according sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREATS = set("kill murder hurt destroy stab shoot strangle bomb töten umbringen erschießen tuer assassiner matar asesinar".split())
INSULTS = set("idiot moron scum loser stupid pathetic worthless disgusting trash clown imbecile bastard dumb idiota imbécile dummkopf abschaum estúpido basura".split())
PATTERN = {INSULT: 1.0, THREAT: 1.0, (INSULT, AIMED): 1.5, (THREAT, AIMED): 1.5, (INSULT, QUOTED): 0.5, (THREAT, QUOTED): 0.5, (INSULT, DENIED): 0.3, (THREAT, DENIED): 0.3}
FIXED_WEIGHT = 4.0
ENDS = ".!?;:\n"


@dataclass
class Transducer:
    """step(state, symbol) -> (state, output symbol); states are small and named, so machines can be composed."""

    start: object
    symbols: list
    step: dict = field(default_factory=dict)

    def then(self, after: Transducer) -> Transducer:
        """This machine followed by ``after`` on its output, as one machine over the reachable pairs of states."""
        start = (self.start, after.start)
        made, waiting = Transducer(start, self.symbols), [start]
        while waiting:
            a, b = state = waiting.pop()
            for symbol in self.symbols:
                next_a, between = self.step[a, symbol]
                next_b, out = after.step[b, between]
                made.step[state, symbol] = ((next_a, next_b), out)
                if ((next_a, next_b), symbol) not in made.step and (next_a, next_b) not in waiting and (next_a, next_b) != state:
                    waiting.append((next_a, next_b))
        return made


def _window(symbols: list, trigger: str, words: int, mark: str) -> Transducer:
    """Marks insults and threats up to ``words`` words behind the trigger."""
    machine = Transducer(0, symbols)
    for left in range(words + 1):
        for symbol in symbols:
            base = symbol[0] if isinstance(symbol, tuple) else symbol
            after = words if base == trigger else max(0, left - 1)
            marked = left and base in (INSULT, THREAT) and not isinstance(symbol, tuple)
            machine.step[left, symbol] = (after, (base, mark) if marked else symbol)
    return machine


def grammar() -> Transducer:
    """Reported speech, then negation, then target, then the weights of the patterns."""
    plain = [OTHER, TARGET, DENIAL, REPORT, INSULT, THREAT]
    reported = Transducer("open", plain)
    for state in ("open", "reported"):
        for symbol in plain:
            after = "reported" if symbol == REPORT else state
            reported.step[state, symbol] = (after, (symbol, QUOTED) if state == "reported" and symbol in (INSULT, THREAT) else symbol)
    quoted = [*plain, (INSULT, QUOTED), (THREAT, QUOTED)]
    denied = [*quoted, (INSULT, DENIED), (THREAT, DENIED)]
    aimed = [*denied, (INSULT, AIMED), (THREAT, AIMED)]
    weights = Transducer("w", aimed, {("w", s): ("w", PATTERN.get(s, 0.0)) for s in aimed})
    return reported.then(_window(quoted, DENIAL, 3, DENIED)).then(_window(denied, TARGET, 5, AIMED)).then(weights)


@dataclass
class Model:
    stems: dict[str, float]  # prefix + "*" or whole word -> weight
    slope: float
    offset: float
    key: str


def bare(token: str) -> str:
    return token.strip("\"'`.,;:!?()[]{}<>*&%$#|-_…«»„“”").lower()


class Tokens(dict):
    """Token -> (symbol, weight, whether a clause ends behind it); ``None`` stands for a plain word inside a clause."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.machine = model, grammar()

    def __missing__(self, token: str):
        word = bare(token)
        ends = token[-1] in ENDS
        symbol, weight = OTHER, 0.0
        if word in TARGETS:
            symbol = TARGET
        elif word in DENIALS:
            symbol = DENIAL
        elif word in REPORTS:
            symbol = REPORT
        elif word in THREATS:
            symbol, weight = THREAT, FIXED_WEIGHT
        stems = self.model.stems
        learned = max([stems.get(word, 0.0), *(stems.get(word[:n] + "*", 0.0) for n in STEM)])
        if symbol == OTHER and (word in INSULTS or learned):
            symbol, weight = INSULT, max(learned, FIXED_WEIGHT if word in INSULTS else 0.0)
        value = self[token] = None if symbol == OTHER and not ends else (symbol, weight, ends)
        return value


def evidence(tokens: Tokens, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """The sum of the matched clauses' scores, and these clauses as first word, number of words, score."""
    words = text.split()
    read = list(map(tokens.__getitem__, words))
    if not any(r[1] for r in set(read) if r):
        return 0.0, []
    machine, total, clauses = tokens.machine, 0.0, []
    state, start, score = machine.start, 0, 0.0
    for at, item in enumerate(read):
        symbol, weight, ends = item or (OTHER, 0.0, False)
        state, pattern = machine.step[state, symbol]
        score += weight * pattern
        if ends or at == len(read) - 1:
            if score:
                clauses.append((start, at + 1 - start, score))
                total += score
            state, start, score = machine.start, at + 1, 0.0
    return total, clauses


def stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: toxic and text to (stem, toxic documents, other documents), summed over runs of the task."""
    release()
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        names = sorted(set(held[0]) | set(held[1]))
        columns = [pa.array(names, pa.string()), pa.array([held[1][n] for n in names], pa.int64()), pa.array([held[0][n] for n in names], pa.int64())]
        for counter in held:
            counter.clear()
        for at in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], ["stem", "toxic", "other"])

    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = set(map(bare, text.split()))
            held[toxic].update({w for w in words if w} | {w[:n] + "*" for w in words for n in STEM if len(w) >= n})
            if len(held[0]) + len(held[1]) > REMEMBERED:
                yield from flush()
    yield from flush()


def context_batches(shared):
    """For ``mapInArrow``: texts to the distinct (stem, word before it) of the candidate stems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        stems, seen = shared.value, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                before = ""
                for word in map(bare, text.split()):
                    if word:
                        seen.update((stem, crc32(before.encode())) for stem in (word, *(word[:n] + "*" for n in STEM)) if stem in stems)
                        before = word
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["stem", "context"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small ridge; classes weigh alike."""
    slope, offset = 1.0, -1.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        gradient = np.array([(r * x).sum() + slope, r.sum() + 0.1 * offset])
        hessian = np.array([[(h * x * x).sum() + 1.0, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - float(np.clip(step[0], -2, 2)), offset - float(np.clip(step[1], -2, 2))
    return slope, offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Stems and curve, from ``labels`` (doc_id, toxic) of rows that may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    fixed = Model({}, 1.0, -1.5, uuid.uuid4().hex)
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    if set(sizes) != {0, 1}:
        return fixed
    share = F.when(F.col("toxic") == 1, int(min(1.0, sample / sizes[1]) * (1 << 30))).otherwise(int(min(1.0, sample / sizes[0]) * (1 << 30)))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < share)  # about 2 * sample rows
    held = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = stored(held.select("toxic", "text"), "toxicity-sample")
    documents = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if set(documents) != {0, 1}:
        return fixed
    counted = texts.mapInArrow(stem_batches, "stem string, toxic long, other long")
    summed = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (documents[1] + 1)) - F.log((F.col("other") + 0.5) / (documents[0] + 1))
    best = summed.withColumn("odds", odds).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    candidates = {r["stem"]: round(min(r["odds"], 8.0), 6) for r in best.select("stem", "odds").collect()}  # bounded by the sample
    known_stems = spark.sparkContext.broadcast(frozenset(candidates))
    contexts = texts.filter("toxic = 1").select("text").mapInArrow(context_batches(known_stems), "stem string, context long")
    varied = contexts.distinct().groupBy("stem").count().filter(F.col("count") >= LEAST_CONTEXTS)
    stems = {r["stem"]: candidates[r["stem"]] for r in varied.select("stem").collect()}
    shorter = lambda s: any(s[:n] + "*" in stems and s != s[:n] + "*" for n in STEM if n < len(s.rstrip("*")) or not s.endswith("*"))
    stems = {s: w for s, w in stems.items() if not shorter(s)}
    model = Model(stems, 1.0, -1.5, uuid.uuid4().hex)
    shared = spark.sparkContext.broadcast(model)
    seen = texts.select(F.col("toxic").cast("long").alias("doc_id"), "text").mapInArrow(evidence_batches(shared), "doc_id long, evidence double, clauses " + CLAUSES)
    binned = seen.select("doc_id", F.round(F.log1p("evidence"), 2).alias("x")).groupBy("doc_id", "x").count().collect()  # a few hundred bins
    x = np.repeat([r["x"] for r in binned], [r["count"] for r in binned])
    y = np.repeat([float(r["doc_id"]) for r in binned], [r["count"] for r in binned])
    slope, offset = _curve(x, y)
    return Model(stems, slope, offset, uuid.uuid4().hex)


CLAUSES = "array<struct<first: int, words: int, score: double>>"


def evidence_batches(shared):
    """For ``mapInArrow``: doc_id and text to doc_id, evidence and matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = only(("toxicity", shared.value.key), lambda: Tokens(shared.value))
        kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64())]))
        for whole in batches:
            for batch in slices(whole):
                if len(tokens) > REMEMBERED:
                    tokens.clear()
                found = [evidence(tokens, text or "") for text in batch.column(1).to_pylist()]
                clauses = pa.array([[{"first": a, "words": n, "score": s} for a, n, s in c] for _, c in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in found], pa.float64()), clauses], ["doc_id", "evidence", "clauses"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence and the matched clauses of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select("doc_id", "text").mapInArrow(evidence_batches(shared), f"{id_type(docs)}, evidence double, clauses {CLAUSES}")
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("evidence") + F.lit(model.offset))))
    return read.select("doc_id", score.alias("score"), "evidence", "clauses")
