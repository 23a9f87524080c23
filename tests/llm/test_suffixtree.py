"""Suffix-tree scores against a brute-force tree of dictionaries, and held-out accuracy."""

from __future__ import annotations

import math
import random
from binascii import crc32
from collections import Counter, defaultdict

import pytest

from deskmill.llm import suffixtree
from deskmill.llm.suffixtree import Growth, Hasher

SMALL = Growth(depth=2, min_context=4, min_entry=2, gain=0.2)


def held_out(i):
    return crc32(("" if i is None else str(i)).encode()) % 10 == 0


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows, growth):
    """``(doc_id, held out, tokens, known, N, base, score)`` of each row; states, shares and counts."""
    texts = [(i, [*words(t), None]) for i, t in rows]
    train = [t for i, t in texts if not held_out(i)]
    count = Counter(x for t in train for x in t)
    total, distinct = sum(count.values()), len(count)

    def base(x):
        return (count[x] + 0.1) / (total + 0.1 * (distinct + 1))

    seen = defaultdict(Counter)
    for t in train:
        for size in range(1, growth.depth + 1):
            for i in range(size, len(t)):
                seen[tuple(t[i - size : i])][t[i]] += 1
    tables = {}

    def share(s, x):
        """Share of ``x`` after candidate ``s``."""
        if not s:
            return base(x)
        table, rest = tables[s]
        own = table.get(x, 0)
        return (own - growth.discount if own else 0) / sum(seen[s].values()) + rest * share(s[1:], x)

    kept = set()
    for size in range(1, growth.depth + 1):
        for s, following in seen.items():
            if len(s) != size or sum(following.values()) < growth.min_context:
                continue
            table = {x: n for x, n in following.items() if n >= growth.min_entry}
            c = sum(following.values())
            rest = 1 - sum(n - growth.discount for n in table.values()) / c
            tables[s] = table, rest
            if not table:
                continue
            apart = sum(share(s, x) * math.log(share(s, x) / share(s[1:], x)) for x in table)
            apart += rest * math.log(rest) * max(1 - sum(share(s[1:], x) for x in table), 0)
            if c * apart >= growth.gain * (len(table) + 1):
                kept |= {s[i:] for i in range(size)}
    out = []
    for i, t in texts:
        total_log = 0.0
        for at, x in enumerate(t):
            s = tuple(t[max(0, at - growth.depth) : at])
            while s and s not in kept:
                s = s[1:]
            total_log += math.log10(share(s, x))
        known = sum(count[x] > 0 for x in t)
        out.append((i, held_out(i), len(t), known, total, sum(math.log10(base(x)) for x in t), total_log))
    return sorted(out, key=repr), kept, share, count


def chain(rng, n):
    after = {f"w{i}": [f"w{(i * 7 + k) % 12}" for k in range(3)] for i in range(12)}
    said, word = [], "w0"
    for _ in range(n):
        word = rng.choice(after[word]) if rng.random() < 0.9 else f"rare{rng.randrange(60)}"
        said.append(word.upper() if rng.random() < 0.1 else word)
        word = word if word in after else "w3"
    return " ".join(said)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, chain(rng, rng.choice([0, 1, 2, 30, 80]))) for i in range(120)]
    rows += [(500, None), (None, "w0 w1 no id"), (501, ""), (501, "  \t\n"), (7, "w0 w1"), (7, "w0 w1"), (502, "é\x0bÀ\x0cß w1")]
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()),
        key=repr,
    )


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("head", "depth"), [(1 << 20, 1), (0, 2), (40, 2), (40, 3)])
def test_scores_equal_brute_force(spark, head, depth):
    growth = Growth(depth=depth, min_context=4, min_entry=2, gain=0.2)
    rows = rows_of(depth)
    want, kept, _, _ = brute(rows, growth)
    assert {len(s) for s in kept} == set(range(1, depth + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(found(suffixtree.lm_scores(df, growth=growth, head=head)), want)


def test_small_chunks_and_hot_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "CHUNK", 20)
    monkeypatch.setattr(suffixtree, "PIECE", 64)
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 50)
    rows = rows_of(9) + [(900, "w0 w1 w2 " * 400), (901, "x" * 1000), (902, "w5 " + "y" * 300 + " w6 " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    same(found(suffixtree.lm_scores(df, growth=SMALL, head=40)), brute(rows, SMALL)[0])


def test_next_symbol_shares_add_up():
    """The scores equal those of the brute-force tree, whose states hold whole distributions."""
    _, kept, share, count = brute(rows_of(4), SMALL)
    assert kept
    for s in kept:
        assert sum(share(s, x) for x in [*count, b"never heard"]) == pytest.approx(1.0)


def test_shared_symbols_are_hashed_anew(spark, monkeypatch):
    real = Hasher._piece

    def weak(self, data):
        symbols, *rest = real(self, data)
        return (symbols % 5 if self.weak else symbols), *rest

    def made(self, seed):
        build(self, seed)
        self.weak = seed == 0

    build = Hasher.__init__
    monkeypatch.setattr(Hasher, "__init__", made)
    monkeypatch.setattr(Hasher, "_piece", weak)
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffixtree.vocabulary(suffixtree.prepared(df))[0] == 1


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixtree.lm_scores(empty).count() == 0
    i = next(i for i in range(100) if held_out(i))
    alone = spark.createDataFrame([(i, "a b", 1, "x", 2)], "doc_id long, text string, n long, key string, held_out int")
    (row,) = suffixtree.lm_scores(alone).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == row.base_score == pytest.approx(0.0)


def test_held_out_texts_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = suffixtree.lm_scores(docs, growth=Growth(min_context=8, min_entry=2)).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_symbols_are_read_in_smaller_pieces_than_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "READ", 10)
    monkeypatch.setattr(suffixtree, "CHUNK", 300)
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 50)
    rows = rows_of(5) + [(900, "w0 w1 w2 " * 400), (901, None), (902, "w5 " + "y" * 300 + " w6 " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    same(found(suffixtree.lm_scores(df, growth=SMALL, head=40)), brute(rows, SMALL)[0])
