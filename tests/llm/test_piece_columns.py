"""Texts are cut, encoded and decoded in columns: a distinct segment is looked up once in a batch, wherever it stands."""

import random

import numpy as np
import pytest
from test_llm_operators import MODEL, random_text

from tidemark.llm import pieces


class Counted(pieces.Memory):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_segment_is_looked_up_once_in_a_batch():
    own = pieces.Pieces(MODEL)
    own.memory, own.segments = Counted(own.memory.make, own.shown), Counted(own.segments.make, own.shown)
    texts = ["water house\n" + "water house " * 500, "water" + " house" * 900]
    own.check(texts, *own.both(texts))
    assert own.memory.asked + own.segments.asked <= 8


def test_segments_of_texts_side_by_side():
    own = pieces.Pieces(MODEL)
    texts = ["", "  a\n\nb c ", "▁▁ x", "", " ", "日本 7é8", "c"]
    segments, places, edges = own.cut(texts)
    assert len(set(segments)) == len(segments)
    cut = [segments[at] for at in places.to_pylist()]
    found = [cut[start:end] for start, end in zip(edges[:-1], edges[1:], strict=True)]
    expected = [[], ["▁▁▁a", "\n", "\n", "b", "▁c", "▁"], ["▁▁▁▁x"], [], ["▁▁"], ["▁日本", "▁", "7", "é", "8"], ["▁c"]]
    assert [["".join(f) for f in found], found] == [[own.library.normalize(t) for t in texts], expected]
    assert own.both([]) == ([], []) and own.both([""]) == ([b""], [""])


def test_batches_of_random_texts():
    rng, own = random.Random(8), pieces.Pieces(MODEL)
    texts = [random_text(rng) for _ in range(600)]
    made, decoded = own.both(texts)
    assert [np.frombuffer(m, "<i4").tolist() for m in made] == [own.library.encode(t) for t in texts]
    assert decoded == [own.library.decode(own.library.encode(t)) for t in texts]


def test_a_wrong_decoding_is_refused():
    own = pieces.Pieces(MODEL)
    made, decoded = own.both(["water house", "a"])
    with pytest.raises(ValueError, match="decoding"):
        own.check(["water house", "a"], made, [decoded[0] + "s", decoded[1]])
