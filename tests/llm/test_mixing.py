"""Mixing: held-out accuracy of the classifier, fitted rates, and edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    bad = ["scum", "vile", "idiot"]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice([0, 0, 0, 1, 2])
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        if kind == 2:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(bad)
        docs.append((i, " ".join(text), "en", "s", 0))
        if i < n // 2:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 2)))
        else:
            labels.append((10_000 + i, 1, 0))  # of no document
    kinds = {d[0]: (1 if "!!" in d[1] else 2 if any(b in d[1].split() for b in bad) else 0) for d in docs}
    return docs, labels, kinds


def test_held_out_and_rates(spark):
    docs, labels, kinds = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    mixed = mixing.mix(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"high": 0.9, "low": 0.1}).collect()
    held = [r for r in mixed if r.doc_id >= 200]
    right = [int(np.argmax([r.p_high, r.p_low, r.p_toxic])) == kinds[r.doc_id] for r in held]
    assert np.mean(right) >= 0.97
    tokens = np.array([r.p_words for r in mixed], float)
    posterior = np.array([[r.p_high, r.p_low, r.p_toxic] for r in mixed])
    rate = np.array([r.rate for r in mixed])
    assert rate.min() >= 0 and rate.max() <= 1
    share = (tokens * rate) @ posterior / (tokens * rate).sum()
    assert abs(share[0] - 0.9) < 0.03 and abs(share[1] - 0.1) < 0.03 and share[2] < 0.02
    assert all(r.kept for r in mixed if kinds[r.doc_id] == 0 and r.p_high > 0.9)
    assert not any(r.kept for r in mixed if kinds[r.doc_id] == 2 and r.p_toxic > 0.95)


def test_replay_is_what_spark_computes(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 50)
    residuals = rng.normal(size=(7, 3))
    names = ["p_high", "p_low", "p_toxic"]
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(p)], "i int, p_high double, p_low double, p_toxic double")
    rated = mixing.with_rates(df, names, residuals, 0.3, "rate").orderBy("i").collect()
    assert np.allclose([r.rate for r in rated], mixing.replay(p, residuals, 0.3, 1.0))


def test_gradient_reaches_least_squares(spark):
    """Targets that nonnegative rates can meet are met."""
    rows = [(i, 10.0 + i, *( [0.8, 0.1, 0.1] if i % 3 == 0 else [0.1, 0.8, 0.1] if i % 3 == 1 else [0.1, 0.1, 0.8])) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, w double, a double, b double, c double")
    residuals, step = mixing.fit_rates(df, ["a", "b", "c"], "w", {"high": 0.5, "low": 0.3, "toxic": 0.2}, max_steps=400, highest=10.0)
    p = np.array([r[2:] for r in rows])
    w = np.array([r[1] for r in rows])
    got = (w * mixing.replay(p, residuals, step, 10.0)) @ p
    assert np.allclose(got / got.sum(), [0.5, 0.3, 0.2], atol=0.01)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1)], [(77, 1, 1), (78, 0, 0)]])
def test_without_usable_labels_all_stay(spark, labels):
    rows = [(1, "a b", "x", "y", 3), (1, "a b", "x", "y", 3), (2, None, None, None, None), (None, "", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine"))
    kept = mixing.mixed_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.count() == 4


def test_edges(spark):
    docs, labels, _ = corpus(120)
    docs += [(500, None, None, None, None), (501, "", "", "", 0), (None, "no id", None, None, 5), (502, "long " * 30_000, "", "", 0), docs[0]]
    df = spark.createDataFrame(docs, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mixed = mixing.mix(df, table)
    assert mixed.count() == len(docs)
    assert mixed.filter("doc_id = 0").select("rate", "kept").distinct().count() == 1
    assert mixing.mix(df.limit(0), table).count() == 0


@pytest.mark.parametrize("leak", [0.0, 0.005])
def test_rare_toxic_domain_is_taken_out(spark, leak):
    """At 1 % of the tokens, with the steps that the stage takes."""
    high, low, toxic = (1 - 2 * leak, leak, leak), (leak, 1 - 2 * leak, leak), (leak, leak, 1 - 2 * leak)
    rows = [(i, 10.0, *map(float, toxic if i % 100 == 0 else low if i % 100 < 12 else high)) for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, w double, a double, b double, c double")
    residuals, step = mixing.fit_rates(df, ["a", "b", "c"], "w", mixing.TARGETS)
    rates = mixing.replay(np.array([toxic, low, high]), residuals, step, 1.0)
    assert rates[0] < 0.001 and rates[2] > 0.99
    if not leak:
        assert abs(rates[1] * 11 - 88 * 5 / 95) < 0.01


def test_rows_that_share_an_id(spark):
    docs, labels, kinds = corpus(200)
    alone = [(None if i % 2 else 77_777, *d[1:]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(docs + alone, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.text for r in mixing.mixed_documents(df, table).filter("doc_id is null or doc_id = 77777").collect()}
    clean = [d[1] for d in docs if kinds[d[0]] == 0]
    toxic = [d[1] for d in docs if kinds[d[0]] == 2]
    assert sum(x in kept for x in clean) >= 0.9 * len(clean)
    assert sum(x in kept for x in toxic) <= 0.1 * len(toxic)
