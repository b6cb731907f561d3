"""Near duplicates from 0.80 on: the stage's threshold, against brute force."""

import random

import pytest
from test_llm_operators import frame

import corpus_pipeline
from tidemark.llm import near_dup


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def brute_left(texts):
    """How many documents stay when links of 0.8 and more join classes."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(shingles(texts[a]) & shingles(texts[b])) >= 4 * len(shingles(texts[a]) | shingles(texts[b])):
                parent[root(a)] = root(b)
    return len({root(i) for i in range(len(texts))})


@pytest.fixture(scope="module")
def texts():
    """Pairs of 204 words (200 shingles); ``edits`` words 10 apart cost 5 shingles each."""
    rng, made = random.Random(80), []
    for n in range(60):
        words = [f"v{rng.randrange(10**6)}" for _ in range(204)]
        other = list(words)
        for k in range((3, 4, 5)[n % 3]):  # 0.86, 0.82, 0.78
            other[10 + 10 * k] = f"e{rng.randrange(10**6)}"
        made += [" ".join(words), " ".join(other)]
    return made


def test_pairs_are_on_both_sides(texts):
    found = {round(similarity(a, b), 2) for a, b in zip(texts[::2], texts[1::2], strict=True)}
    assert found == {0.86, 0.82, 0.78}


def test_stage_takes_pairs_from_080_on(spark, folder, texts):
    docs = frame(spark, list(enumerate(texts)))
    left = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert left.count() == brute_left(texts) == 80
    assert near_dup.drop_near_copies(docs, near=85).count() == 100


def test_bands_miss_next_to_nothing_at_080():
    assert (1 - (corpus_pipeline.NEAR / 100) ** near_dup.ROWS) ** near_dup.BANDS < 1e-7
    assert near_dup.ROWS * near_dup.BANDS <= near_dup.HASHES
