"""Pairs of pieces are looked up by place; whole odd texts are as the library gives them."""

import numpy as np
from test_llm_operators import MODEL, ODD

from tidemark.llm import pieces


def test_pairs_are_found_in_their_places():
    own, rng = pieces.Pieces(MODEL), np.random.default_rng(5)
    n = len(own.names)
    ranks, joined = own.pair_costs(own.pair_keys // n, own.pair_keys % n)
    assert (ranks == own.pair_ranks).all() and (joined == own.pair_joined).all()
    left, right = rng.integers(0, n, 200_000), rng.integers(-1, n, 200_000)
    known = set(own.pair_keys.tolist())
    found = own.pair_costs(left, right)[0] != pieces.NO_PAIR
    assert found.tolist() == [b >= 0 and a * n + b in known for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    costs = [own.cost[own.names[i]] for i in own.pair_joined.tolist()]
    order = np.argsort(costs, kind="stable")
    assert (np.diff(own.pair_ranks[order]) >= 0).all() and len(set(costs)) == own.pair_ranks.max() + 1


def test_whole_odd_texts_as_the_library_gives_them():
    own = pieces.Pieces(MODEL)
    texts = [t or "" for t in ODD] + ["häuser\nWörter, 日本 😀!! ▁", "x" * 31 + " " + "y" * 32 + " " + "z" * 33]
    for _ in range(2):  # the second time from memory
        own.check(texts, *own.both(texts))
