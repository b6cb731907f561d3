"""Agendas as list and as heap agree; whole texts are checked against the library in every batch, also where all segments come from memory."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pieces
from tidemark.llm.queries import vocabulary


def test_a_wrong_segment_in_memory_raises_in_a_later_batch():
    path = vocabulary("piece_bpe_32k.model")
    run = pieces.encode_batches(path)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["water house"])], ["doc_id", "text"])
    assert len(list(run(iter([batch])))) == 1
    memory = pieces.load(path).memory
    memory["house"] = memory["water"]
    with pytest.raises(ValueError, match="differ"):
        list(run(iter([batch])))
    memory.clear()


def test_both_agendas_agree():
    own, rng = pieces.Pieces(vocabulary("piece_bpe_32k.model")), random.Random(6)
    names = [n for n in own.ids if len(n) > 1]
    for _ in range(3000):
        segment = "".join(rng.choices(names, k=rng.randint(1, 4))) + "".join(rng.choices("aeinst\u00e9\u2581xz", k=rng.randint(0, 9)))
        assert own.merge_few(list(segment)) == own.merge_many(list(segment)), segment


def test_segments_side_by_side_agree():
    own, rng = pieces.Pieces(vocabulary("piece_bpe_32k.model")), random.Random(7)
    names = [n.strip(pieces.SPACE) for n in own.ids if len(n.strip(pieces.SPACE)) > 1]
    words = {"".join(rng.choices(names, k=rng.randint(1, 4))) + "".join(rng.choices("aeinst\u00e9xz\u65e5", k=rng.randint(0, 9))) for _ in range(4000)} | {"a", "\n", "\nab"}
    own.learn(own.memory, words)
    assert len(own.memory) > 3000
    for word, (ids, shown) in own.memory.items():
        segment = own.segment_of(word)
        alone = own.merged(segment)
        assert np.frombuffer(ids, "<i4").tolist() == alone and shown == b"".join(own.shown[i] for i in alone), word
