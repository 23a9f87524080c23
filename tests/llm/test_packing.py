"""Packing: pieces against the tokenizer, plans and placements against their rules."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from deskmill.llm import packing
from deskmill.llm.tokens import PieceCodes, vocabulary


def check_plan(counts, kinds, capacity):
    got = Counter()
    for kind in kinds:
        assert sum(kind.items) + kind.room == capacity and kind.room >= 0 and kind.bins > 0
        for length in kind.items:
            got[length] += kind.bins
    assert got == Counter(counts)


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 2048])
    top = rng.choice([capacity, capacity // 2, max(1, capacity // 5)])
    counts = {n: rng.choice([1, 2, 50, 5_000]) for n in rng.sample(range(1, top + 1), min(top, rng.randrange(1, 120)))}
    first = packing.best_fit(dict(counts), capacity)
    check_plan(counts, first, capacity)
    better = packing.local_search(first, capacity)
    check_plan(counts, better, capacity)
    bins = sum(k.bins for k in better)
    assert -(-sum(n * c for n, c in counts.items()) // capacity) <= bins <= sum(k.bins for k in first)


def test_local_search_empties_bins():
    # Moves alone do: the twos of the last bin fit beside the others.
    start = [packing.Kind([8], 1, 2), packing.Kind([7], 1, 3), packing.Kind([2, 2], 1, 6)]
    done = packing.local_search(start, 10)
    check_plan({8: 1, 7: 1, 2: 2}, done, 10)
    assert sum(k.bins for k in done) == 2
    # Here a three must first be exchanged for a two.
    start = [packing.Kind([6, 2], 1, 2), packing.Kind([7], 1, 3), packing.Kind([4, 1], 1, 5)]
    done = packing.local_search(start, 10)
    check_plan({6: 1, 2: 1, 7: 1, 4: 1, 1: 1}, done, 10)
    assert sum(k.bins for k in done) == 2


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "é1", "x,y", "Zürich"]) for _ in range(rng.choice([0, 3, 90, 400, 3000])))) for i in range(120)]
    rows += [(500 + i, "same length") for i in range(300)] + [(7, None), (None, "no id"), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    codes = PieceCodes(vocabulary())
    want = Counter()
    total = 0
    for i, text in rows:
        ids = np.array([*codes.ids(text or ""), 0], "<u4")
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    packed = packing.pack_documents(df, with_ids=True).cache()
    found = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # No worse than first fit, longest piece first.
    rooms = []
    for n in sorted((r.length for r in found), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(2048 - n)
        else:
            rooms[at] -= n
    assert -(-total // 2048) <= len(bins) <= len(rooms)
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in parts) for s, parts in bins.items()}


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
