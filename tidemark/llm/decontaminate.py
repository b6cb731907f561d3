"""Benchmark passages in training text: windows of 13 words, found through a broadcast hash set.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Each item gives every run of 13 words, or all its
words when it has fewer. Training text is scanned once: hashes of one word are combined pairwise into hashes of 2, 4, 8 and then the
wanted number of words, so a window costs a few operations and not thirteen. Window hashes meet the broadcast hashes of the
items; documents with a meeting are then verified word by word. The hash set is broadcast when a count proves it has at most
``BROADCAST_ROWS`` rows; beyond that the same join is a shuffle.

A document is contaminated when at least one word is hit and the hit words are at least a twentieth of its words.

Defined results: null and empty texts have no words, no hits and are clean; items without words give no windows; repeated documents
are judged alike, row by row; repeated items count once per item_id; an empty benchmark leaves every document clean; an empty table gives no
rows; columns other than doc_id and text (item_id and text of the benchmark) are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fold_ascii, stored, text_of
from tidemark.session import small_side

WINDOW = 13
SHARE = 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold_ascii(text), BREAKS), lambda w: w != "")


def _joined(left: Column, right: Column, shift: int) -> Column:
    """Hashes of the runs at i and at i + shift taken together, as long as there are both."""
    length = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), length), F.slice(right, F.lit(shift + 1), length), lambda a, b: F.xxhash64(a, b))


def run_hashes(frame: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds h<length> for each length: the hash of the run of that many words that begins at each word. Needs ``words``."""
    built = frame.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {1}
    power = 1
    while power * 2 <= max(lengths):
        built = built.withColumn(f"h{power * 2}", _joined(F.col(f"h{power}"), F.col(f"h{power}"), power))
        power *= 2
        have.add(power)
    for length in sorted(lengths):
        rest, at, parts = length, 0, []
        for size in sorted((p for p in have if p & (p - 1) == 0), reverse=True):
            if rest & size:
                parts.append((size, at))
                at, rest = at + size, rest - size
        if len(parts) > 1:
            whole = F.col(f"h{parts[0][0]}")
            for size, start in parts[1:]:
                whole = _joined(whole, F.col(f"h{size}"), start)
            built = built.withColumn(f"h{length}", whole)
            have.add(length)
    return built.drop(*(f"h{n}" for n in have - set(lengths)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, length, run): the windows of every item, as words joined by a blank."""
    words = benchmark.select("item_id", words_of(text_of()).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    runs = F.transform(starts, lambda s: F.array_join(F.slice(F.col("words"), s, length), " "))
    return words.select("item_id", length.alias("length"), F.explode(runs).alias("run")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """One row per distinct (doc_id, text) with a verified hit: name, sha, met (first word from 0, length, run); and the items' windows."""
    items = stored(benchmark_windows(benchmark, window), "bench-windows")
    lengths = [r["length"] for r in items.select("length").distinct().collect()]  # at most ``window`` values
    runs = items.select("length", "run").distinct()
    hashed = run_hashes(runs.withColumn("words", F.split("run", " ")), lengths or [window])
    of_length = F.coalesce(*(F.when(F.col("length") == n, F.col(f"h{n}")[0]) for n in lengths or [window]))
    keys = stored(hashed.select("length", of_length.alias("h"), "run"), "bench-keys")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.filter("text is not null").select(name.alias("name"), F.sha2("text", 256).alias("sha"), "text")
    scanned = run_hashes(texts.withColumn("words", words_of(F.col("text"))), lengths or [window])
    arrays = F.array(*(F.struct(F.lit(n).alias("length"), F.col(f"h{n}").alias("hs")) for n in lengths or [window]))
    if len(lengths) <= 1:
        seen = scanned.select("name", "sha", F.lit((lengths or [window])[0]).alias("length"), F.posexplode_outer(f"h{(lengths or [window])[0]}").alias("at", "h"))
    else:
        seen = scanned.select("name", "sha", F.explode_outer(arrays).alias("of")).select("name", "sha", F.col("of.length").alias("length"), F.posexplode_outer("of.hs").alias("at", "h"))
    # Outer explodes, as the others would pull a filter on the array below the projections and compute the hashes once per use.
    met = seen.join(small_side(keys), ["length", "h"])
    candidates = met.groupBy("name", "sha").agg(F.collect_set(F.struct("at", "length", "run")).alias("met"))
    same = lambda m: F.array_join(F.slice(F.col("words"), m["at"] + 1, m["length"]), " ") == m["run"]
    found = stored(candidates, "bench-met")
    again = texts.join(found, ["name", "sha"]).withColumn("words", words_of(F.col("text"))).withColumn("met", F.array_sort(F.filter("met", same)))
    kept = again.filter(F.size("met") > 0).select("name", "sha", "met")
    return stored(kept.dropDuplicates(["name", "sha"]), "bench-hits"), items


def covered(spans: Column) -> Column:
    """Words inside the union of spans that are sorted by their first word."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(state: Column, span: Column) -> Column:
        end = (span["at"] + span["length"]).cast("long")
        added = F.greatest(end - F.greatest(state["end"], span["at"].cast("long")), F.lit(0).cast("long"))
        return F.struct((state["n"] + added).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda s: s["n"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, name, sha, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    verified, items = hits(docs, benchmark, window)
    runs = verified.select("name", "sha", F.explode(F.array_distinct(F.transform("met", lambda m: F.struct(m["length"], m["run"])))).alias("m"))
    named = runs.select("name", "sha", "m.*").join(small_side(items), ["length", "run"])
    listed = named.groupBy("name", "sha").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = F.transform("met", lambda m: F.struct(m["at"].alias("at"), m["length"].alias("length")))
    marks = verified.select("name", "sha", spans.alias("spans")).join(listed, ["name", "sha"])
    marks = marks.select("name", "sha", "spans", "items", covered(F.col("spans")).alias("hit"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = docs.select("doc_id", name.alias("name"), F.sha2(text_of(), 256).alias("sha"), F.size(words_of(text_of())).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    whole = counted.join(marks, ["name", "sha"], "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    listed_items = F.coalesce("items", none)
    return whole.select(
        "doc_id", "name", "sha", "n_words", n_hit.alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The clean documents, every column as it was; rows with a null or unhit text stay."""
    bad = judged(docs, benchmark, window, share).filter("contaminated").select("name", "sha").distinct()
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    whole = docs.select(F.struct("*").alias("whole"), name.alias("name"), F.sha2(text_of(), 256).alias("sha"))
    return whole.join(bad, ["name", "sha"], "left_anti").select("whole.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and text of every document, the hit words taken out (folded words joined by a blank where any was hit)."""
    marks = judged(docs, benchmark, window)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "text", name.alias("name"), F.sha2(text_of(), 256).alias("sha"))
    hit = marks.filter("n_hit > 0").select("name", "sha", "spans").dropDuplicates(["name", "sha"])
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"] + 1, s["at"] + s["length"])))
    words = words_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(1), F.size(words)), places)
    rest = F.array_join(F.transform(left, lambda n: F.element_at(words, n)), " ")
    return rows.join(hit, ["name", "sha"], "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest).alias("text"))
