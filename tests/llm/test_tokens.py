"""Piecewise token ids against the tokenizer on whole texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from deskmill.llm.tokens import PieceCodes, encoder, vocabulary

EDGES = [
    "",
    "   ",
    "The, the. THE!! don't we'll <|endoftext|> x<|startoftext|>",
    "Größe ÀÉÎ straße ﬁ ǅ İstanbul ΣΑΣ σας",
    "été a b c\x1cd\x85e\x0bf",
    "日本語 テキスト 한국어 🙂🙂👍🏽",
    "a" * 5_000,
    "1234 5,6.7 $%&*# foo_bar a.b.c",
]


@pytest.fixture(scope="module")
def codes():
    return PieceCodes(vocabulary())


def check(codes, texts):
    for text, ids in zip(texts, encoder(vocabulary(), 0)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == [*codes.ids(text), 0]


def test_edges(codes):
    check(codes, EDGES)


def test_random_texts(codes):
    rng = random.Random(3)
    letters = "abcABC éÉßüÀ .,!?%$ \n\t'<|>_-01 ΩΣσ́日"
    check(codes, ["".join(rng.choice(letters) for _ in range(200)) for _ in range(300)])


def test_specials_as_plain_text():
    text = "a <|endoftext|> b"
    (plain,) = encoder(vocabulary(), 49_407, plain_specials=True)([text])
    assert np.frombuffer(plain, "<u4").tolist().count(49_407) == 1
