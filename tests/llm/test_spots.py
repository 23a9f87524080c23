"""Spot signatures: edits, neighbours and the whole-table comparison against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from deskmill.llm import spots


def prose(rng, n):
    words = ["the", "of", "and", "der", "la"] * 6 + [f"w{i}" for i in range(200)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i * 3 - 40, prose(rng, rng.choice([0, 1, 5, 40, 300]))) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies
    rows += [(5, None), (5, "tie b"), (5, "tie a"), (None, "no id"), (None, "none"), (2**60, "é" * 1001), (2**60 + 1, "x y" * 40_000)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        a, b, c = spots.signatures(t), spots.signatures(new), spots.signatures(after)
        out.append(
            (i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9))
        )
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()),
        key=repr,
    )


@pytest.mark.parametrize("range_docs", [10, 10_000])
def test_edits_equal_brute_force(spark, monkeypatch, range_docs):
    monkeypatch.setattr(spots, "RANGE_DOCS", range_docs)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spots.edit_fingerprints(df).cache()
    assert found(got) == expected(rows)
    for r in got.collect():
        own = {int(r.fingerprint[i : i + 8], 16) for i in range(0, len(r.fingerprint), 8)}
        assert spots.write_out(own) == r.fingerprint


def test_single_and_empty(spark):
    schema = "doc_id long, text string"
    assert found(spots.edit_fingerprints(spark.createDataFrame([(1, "the cat sat down")], schema))) == expected([(1, "the cat sat down")])
    assert spots.edit_fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_signatures():
    one = spots.signatures("The quick brown fox of a very red hen")
    # the -> quick brown; of, a -> very red
    assert len(one) == 3
    assert one == spots.signatures("the QUICK, brown! fox of a very red hen")
    assert spots.signatures("zero anchors here whatever") != spots.signatures("zero anchors here")
    assert spots.likeness({1, 2, 3}, {2, 3, 4}) == 0.5
    assert spots.likeness({1}, {1, 2, 3, 4, 5}, 0.8) == 0.0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for d in range(12):
        base = prose(rng, rng.choice([30, 120, 400])).split()
        for v in range(6):
            text = list(base)
            for _ in range(rng.choice([0, 1, 3, len(text) // 8])):
                text[rng.randrange(len(text))] = f"n{rng.randrange(1000)}"
            rows.append((10 * d + v, " ".join(text)))
    members, pairs = spots.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=0.8)
    classes = {r.doc_id: r["class"] for r in members.collect()}
    sets = {classes[i]: spots.signatures(t) for i, t in rows}
    names = sorted(sets)
    want = {
        frozenset((a, b))
        for i, a in enumerate(names) for b in names[i + 1 :]
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and want
