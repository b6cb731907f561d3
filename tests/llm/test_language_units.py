"""Languages written without blanks: loss grows with the letters of a token, and each run is judged by its own script."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import frame

from tidemark.llm import language

HAN = "的一是不了在人有我他这中大来上个国到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长"
ENGLISH = "the and of with house water think through".split()


def chinese(rng, n):
    return "".join(rng.choices(HAN, k=n))


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(ENGLISH, k=30)), "en") for i in range(40)] + [(40 + i, "，".join(chinese(rng, 20) for _ in range(4)), "zh") for i in range(40)]
    return language.Words(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)))


def test_a_passage_without_blanks_outweighs_a_few_words(spark, words):
    text = "the house of water " + chinese(random.Random(5), 20_000)
    row = language.labelled(frame(spark, [(1, text)]), words.model).first()
    assert row["lang_pred"] == "zh" and row["score"] == pytest.approx(20_000 / 20_015)
    assert [(s["first"], s["words"], s["lang"]) for s in row["spans"]] == [(0, 4, "en"), (4, 1, "zh")]


def test_a_sentence_that_begins_with_a_latin_letter(words):
    text = "A" + chinese(random.Random(6), 300)
    lang, score, spans = language.label_texts(words, [text])[0]
    assert (lang, spans) == ("zh", [(0, 1, "zh")]) and score > 0.99


def test_two_languages_in_one_token_share_its_letters(words):
    text = "water" * 40 + chinese(random.Random(7), 100)
    lang, score, spans = language.label_texts(words, [text])[0]
    assert (lang, spans) == ("en", [(0, 1, "en")]) and score == pytest.approx(200 / 300)


def test_units():
    assert language.units_of("über") == [("über", "latin")]
    assert language.units_of("ab中文中文中の") == [("ab", "latin"), ("中文中文", "han"), ("中", "han"), ("の", "kana")]
    assert [len(u) for u, _ in language.units_of("x" * 90)] == [40, 40, 10]


def test_memory_is_bounded_by_bytes(words):
    held = language.Words(words.model)
    for n in range(50):
        texts = [" ".join(f"{100_000 * n + i}" for i in range(50_000)), " ".join(f"house{100_000 * n + i}" for i in range(50_000))]
        language.label_texts(held, texts)
        tokens = sum(len(t) for t in held) + 100 * len(held)
        assert tokens <= held.held <= language.REMEMBERED + 100_000 * 200
    assert len(held) < 1_000_000  # of five million
