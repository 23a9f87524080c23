"""Quality rules: the base measures against a plain restatement, and the verdicts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from deskmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked), failed


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "one", "a b c a b c", "x " * 60, "é b \x0b c\x1cd\x85 " * 20, "w " * 30_000]
    for _ in range(300):
        n = rng.choice([3, 30, 60, 200])
        words = [rng.choice(["the", "cat", "é", "#a", "|", "日本", "<b>"]) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(n)]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t", "\r\n"]) for w in words))
    return out


def test_base_measures(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in quality.with_verdict(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(rows[r.doc_id][1])
        assert not (r.base_failed and r.kept)


PROSE = "\n".join("Line " + " ".join(f"w{i}x{j}" for j in range(12)) + " ends." for i in range(8))


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A plain sentence with some words in it.", None),
        ("Ein Satz ohne Punkt, der aber lang genug ist und weitergeht", None),
        ("Home", "navigation"),
        ("Home About Contact", "navigation"),
        ("12 34 56 78 90 12 34 56 78", "navigation"),
        ("one | two | three | four | five", "punctuation"),
        ("word*** other### more%%% thing$$$ last.", "punctuation"),
        ("Buy!! now!! or!! never!! again!!", "punctuation"),
        ("THIS IS ALL VERY LOUD INDEED AND GOES ON.", "shouting"),
        ("We value you. All rights reserved.", "boilerplate"),
    ],
)
def test_line_rules(line, rule):
    assert quality.failing_rule(line, len(line.split()), quality.Rules()) == rule


def test_documents(spark):
    rows = [
        (1, PROSE, "en"),
        (2, PROSE + "\nHome\nAll rights reserved.\n", "en"),
        (3, PROSE.upper(), "en"),
        (4, PROSE + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(90)), "en"),
        (5, None, None),
        (None, PROSE, None),
        (1, PROSE, "en"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.kept) for r in kept.collect()), key=repr) == sorted(
        [(1, PROSE, "en"), (1, PROSE, "en"), (2, PROSE + "\n", "en"), (None, PROSE, None)], key=repr
    )
    sized = quality.clean_documents(docs.selectExpr("*", "cast(0 as bigint) n_chars")).filter("doc_id = 2").first()
    assert sized.n_chars == len(PROSE) + 1
    assert quality.clean_documents(docs.limit(0)).count() == 0


def test_labelled_documents(spark, sf_dir):
    """Of the documents that pass the base rules, the labelled good ones stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.with_verdict(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in judged if r.quality == 1]
    poor = [r.kept for r in judged if r.quality == 0]
    assert all(good) and sum(poor) <= 0.1 * len(poor)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("She kept a blog in which the journey was told day by day.", None),
        ("The catalog in the hall lists every book that they own.", None),
        ("There is good design in even the smallest of these tools.", None),
        ("The news was spread more widely than anyone had hoped.", None),
        ("Der Datenschutz ist in Europa seit Jahren ein Thema der Politik.", None),
        ("Guests sign in at the desk before they go up to their rooms.", None),
        ("The firm changed its privacy policy after the users complained.", None),
        ("Click here to read more.", "boilerplate"),
        ("This site uses cookies, see our privacy policy and our terms of use for all that they do.", "boilerplate"),
        ("Impressum, Datenschutz, alle Rechte vorbehalten, bitte hier weiterlesen.", "boilerplate"),
        ("Read our privacy policy.", "boilerplate"),
    ],
)
def test_boilerplate_needs_whole_phrases_and_a_further_sign(line, rule):
    assert quality.failing_rule(line, len(line.split()), quality.Rules()) == rule
