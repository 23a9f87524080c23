"""Ranked search against SQL, and the trie against scoring every document."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from deskmill.llm import fptree


def rows_of(seed, docs=300, items=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "X9"]
    weights = [1 / (1 + i) for i in range(len(words))]

    def said(n):
        return rng.choice([" ", "-", ", "]).join(rng.choices(words, weights, k=n))

    texts = [(i, said(rng.choice([0, 1, 4, 30, 120]))) for i in range(docs)]
    texts += [(1000 + i, texts[5][1]) for i in range(70)]  # copies: ties by id
    texts += [(7, "W0 w0 w1"), (7, "w0 w1 W0"), (2000, None), (2001, ""), (None, "w0 w1 w2"), (2002, "w3 " * 30_000)]
    asked = [(i, said(rng.choice([1, 3, 12]))) for i in range(items)]
    asked += [(900, None), (901, ""), (902, "unheard of"), (3, "w9 w10"), (None, "w4 w5")]
    rng.shuffle(texts)
    return texts, asked


def by_sql(texts, asked):
    con = duckdb.connect()
    docs = pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    items = pd.DataFrame(asked, columns=["item_id", "text"]).astype({"item_id": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM docs")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM items")
    # rows without an item id are one item: the SQL keeps them apart from none else
    return sorted(con.sql(fptree.ORACLE_SQL).fetchall(), key=repr)


def found(spark, texts, asked, **options):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(asked, "item_id long, text string")
    rows = fptree.search(docs, items, **options).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize(("block", "leaf"), [(8192, 24), (50, 3)])
def test_equals_sql(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(fptree, "BLOCK_DOCS", block)
    monkeypatch.setattr(fptree, "LEAF_DOCS", leaf)
    texts, asked = rows_of(1)
    assert found(spark, texts, asked) == by_sql(texts, asked)


def test_items_in_blocks(spark):
    texts, asked = rows_of(2)
    assert found(spark, texts, asked, item_chars=40) == by_sql(texts, asked)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    paths = [np.unique(rng.zipf(1.4, 40) % 200) for _ in range(2000)]
    paths += [paths[3]] * 60
    tfs = [rng.integers(1, 9, len(p)) for p in paths]
    m = rng.integers(50, 400, len(paths))
    trie = fptree.Trie(paths, tfs, m)
    for at, node in enumerate(trie.runs):
        assert (at in trie.children) or node[1] - node[0] <= fptree.LEAF_DOCS
    assert sorted(trie.order.tolist()) == list(range(len(paths)))
    scored = 0
    for _ in range(40):
        weights = np.zeros(200, np.int64)
        asked = rng.choice(np.arange(20, 200), 6, replace=False)
        weights[asked] = rng.integers(1, 9000, 6)
        exact = sorted(
            (int(sum(weights[t] * fptree.gain(np.int64(f), np.int64(k)) for t, f in zip(p, tf))) for p, tf, k in zip(paths, tfs, m)),
            reverse=True,
        )
        best = fptree.Best(10)
        scored += trie.search(weights, best.least, lambda s, i: best.offer(s, (i,), i))
        assert sorted((e[0] for e in best.heap), reverse=True) == [s for s in exact[:10] if s > 0]
    assert scored < 40 * len(paths) * 0.9


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, term string, score long")
    items = spark.createDataFrame([(4, "B", 1)], "item_id long, text string, doc_id int")
    (row,) = fptree.search(docs, items).collect()
    assert (row.item_id, row["rank"], row.doc_id) == (4, 1, 1) and row.score > 0
    assert fptree.search(docs.limit(0), items).count() == 0
    assert fptree.search(docs, items.limit(0)).count() == 0
