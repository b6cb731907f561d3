"""Letters, line breaks before them and signs behind them do without the pre-tokenizer, with the library's ids."""

import random

from test_llm_operators import JSON

from tidemark.llm import token_files


def test_letters_and_signs_do_without_the_pre_tokenizer():
    own, rng = token_files.Encoder(JSON), random.Random(3)
    assert own.parted
    own.runs |= {s: own._ids(s) for s in ("$$$", "!!", "'", "_?")}
    split, own.split = own.split, None
    for text in (" häuser$$$", "\nhouse", "\nWörter!!", " it'", " a_?"):
        assert own[text.removeprefix(" ")] == own.whole(text), text
    own.split = split
    parts = ["\n", " ", "a", "Be", "é", "ß", "²", "½", "Ⅷ", "'s", "'", "!", "__", "<|endoftext|>", ".", "日", "1", "$$", "\t", " ", "ʼ", "ll"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 20)))
        assert own.encode(text) == own.whole(text), text
