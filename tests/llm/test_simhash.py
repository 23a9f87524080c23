"""SimHash: fingerprints, bit planes and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deskmill.llm import simhash
from deskmill.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    """Component per index, by comparing all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(rng, n):
    values = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(values) < n:
        value = rng.choice(values)
        for _ in range(rng.randrange(4)):
            value ^= 1 << rng.randrange(64)
        values.append(value)
    return values


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_planes(radius):
    rng = random.Random(radius)
    values = near_values(rng, 90)
    planes = simhash.BitPlanes(np.array([signed(v) for v in values], np.int64))
    for v in values[:40]:
        lanes = planes.near(signed(v), radius, planes.full)
        assert lanes == sum(1 << i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius)


@pytest.mark.parametrize("radius, block", [(2, 4096), (2, 8), (3, 4096), (0, 4096)])
def test_links_connect_all_near_values(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    values = sorted(set(near_values(rng, 400)))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.near_links(df, "fp", radius).collect()
    index = {signed(v): i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (a ^ b & (1 << 64) - 1) is not None and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == groups(values, radius)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for v in sorted(near):
        if v in seen:
            continue
        stack, seen = [v], seen | {v}
        while stack:
            x = stack.pop()
            want[x] = v
            stack += near[x] - seen
            seen |= near[x]
    assert {r.vertex: r.component for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(10, None), (11, ""), (12, " \t\n"), (13, "Ä one"), (14, "ä one"), (15, "x"), (16, "A b"), (17, "a B")]
    for d in range(30):
        text = [rng.choice(words) for _ in range(rng.choice([4, 60, 700]))]
        for v in range(5):
            copy = list(text)
            for _ in range(v):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + 10 * d + v, " ".join(copy)))
    rows += [(900 + i, rows[20][1]) for i in range(40)] + [(901, rows[20][1]), (None, rows[20][1]), (None, "alone with no id")]
    rng.shuffle(rows)
    return rows


def test_components_of_documents(spark):
    rows = corpus()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = groups(prints, 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(4)
    found = simhash.simhash_components(df).collect()
    assert sorted((tuple(r) for r in found), key=repr) == want


def test_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, component_id string")
    kept = simhash.one_of_each(df).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = groups(prints, 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    alone = [r for (i, _), r in zip(rows, roots) if i is None and r not in least]
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert len([r for r in kept if r.doc_id is None]) >= len(alone)
    assert kept[0].component_id == "k"
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (0, c), (2, c), (None, d), (None, d), (None, a), (5, "alone")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([(1, a), (1, b), (0, c), (None, d), (5, "alone")], key=repr)
