"""Token counts read back from flat files against the tokenizer."""

from __future__ import annotations

import random

import pytest

from deskmill.llm import separators
from deskmill.llm.tokens import PieceCodes, vocabulary


@pytest.mark.parametrize("block_ids", [1, 7, 64, 1 << 18])
def test_counts(spark, block_ids):
    rng = random.Random(block_ids)
    rows = [(i, " ".join(rng.choice(["cat", "the", "é", "x<|endoftext|>y"]) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(60)]
    rows += [(1, None), (None, "no id"), (2, ""), (2, "")]
    rng.shuffle(rows)
    codes = PieceCodes(vocabulary(), plain_specials=True)
    want = sorted(((i, len(codes.ids(t or ""))) for i, t in rows), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = separators.token_counts(df, block_ids=block_ids, id_bytes=2 if block_ids > 7 else 4).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == want


def test_one_document_over_many_blocks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "cat " * 5000), (3, "b c")], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in separators.token_counts(df, block_ids=16).collect()}
    assert found == {1: 1, 2: 5000, 3: 2}


def test_empty(spark):
    assert separators.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
