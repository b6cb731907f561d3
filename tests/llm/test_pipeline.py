"""The corpus pipeline against a plain version of its stages."""

import hashlib
import random

import pytest
from test_llm_operators import brute_classes, copies, library, squeezed

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, whole string, name string, sha string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "w", "n", "s") for i, t, lang in rows], COLUMNS)


def folded(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def expected(rows, items):
    rows = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in rows:
        key, rank = squeezed(t), (-len(t), i)
        first[key] = min(first.get(key, (rank, t)), (rank, t))
    rows = sorted((rank[1], t) for rank, t in first.values())
    rows = [(i, t) for (i, t), (_, _, component) in zip(sorted(rows, key=repr), brute_classes(rows), strict=True) if i == component]
    left = []
    for i, text in rows:
        own, hit = folded(text), set()
        for item in map(folded, items):
            n = min(13, len(item))
            for at in range(len(own) - n + 1):
                if any(own[at : at + n] == item[k : k + n] for k in range(len(item) - n + 1)):
                    hit.update(range(at, at + n))
        if not hit or 20 * len(hit) < len(own):
            ids = library().encode(text)
            left.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library().decode(ids).encode()).hexdigest()))
    return sorted(left)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    english, german = "the and of with house water think through".split(), "der und nicht mit haus wasser über schön".split()
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    items = [text(english, 30), text(german, 20), "only four words here"]
    texts = []
    for n in range(40):
        words, lang = ((english, "en"), (german, "de"))[n % 2]
        base = text(words, rng.randint(60, 200))
        texts += [(base, lang)] + ([(t, lang) for t in copies(rng, base, 3, 2)] if n % 4 == 0 else []) + ([(base.replace(" ", "  ", 2), lang)] if n % 5 == 0 else [])
    texts += [(text(english, 20) + " " + items[0], "en"), (text(english, 900) + " " + items[0][:120], "en"), (items[1], None), (None, "en"), ("", "en"), ("12 34 !!", "en")]
    rng.shuffle(texts)
    return [(i, t, lang) for i, (t, lang) in enumerate(texts)], items


def test_pipeline(spark, folder, corpus):
    rows, items = corpus
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, folder)
    want = expected(rows, items)
    assert sorted(map(tuple, found.collect())) == want
    assert 20 < len(want) < len(rows) - 30


def test_stages_pass_an_empty_table(spark, folder):
    docs = table(spark, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        assert done.count() == 0, name
        assert name == "sentencepiece" or done.columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_repeated_rows_leave_one(spark, folder):
    long = "the house and the water of the house with water and think through the water"
    docs = table(spark, [(7, long, "en")] * 3 + [(None, long + " once", "en")] * 2)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "stage")
        sizes.append(docs.count())
    assert sizes[:2] == [5, 2] and sizes[-1] == sizes[-2] >= 1
