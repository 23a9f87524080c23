"""Line dedup against brute force over all pairs of lines."""

from __future__ import annotations

import random
import re

import pytest

from deskmill.llm import linedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Per row index, the line numbers that have an earlier match."""
    lines = []
    for i, (doc_id, text) in enumerate(rows):
        for ln, line in enumerate((text or "").split("\n") if text is not None else []):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if words:
                lines.append(((doc_id is not None, doc_id or 0, ln), i, ln, words))
    gone = {}
    for key, i, ln, words in lines:
        for other, _, _, theirs in lines:
            if other < key and 5 * len(words & theirs) >= 4 * len(words | theirs):
                gone.setdefault(i, set()).add(ln)
                break
    return gone


def expected(rows):
    gone = brute(rows)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        cut = gone.get(i, set())
        if cut:
            text = "\n".join(x for ln, x in enumerate(text.split("\n")) if ln not in cut)
        out.append((doc_id, text, len(cut)))
    return sorted(out, key=repr)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    pool = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 12, 40, 150]))] for _ in range(25)]
    rows = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, len(line) // 5])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_edges(spark):
    line = "one two three four five six"
    rows = [
        (None, line),
        (1, line.upper()),
        (1, line.upper()),  # a repeated row
        (2, None),
        (3, ""),
        (4, "\n\n"),
        (5, "one two three\n" + line + "\ta " * 5),
        (6, "long " * 20_000 + "tail"),
        (7, " ".join(f"x{i}" for i in range(3_000)) + "\nkept only once, five words"),
        (8, " ".join(f"x{i}" for i in range(2_900)) + "\nkept only once, five words"),
        (9, line + " seven eight"),
    ]
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_near_copies_and_hot_lines(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(200):
        line = list(base)
        for _ in range(rng.randrange(0, 9)):
            line[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
        rows.append((d, "the very same line in all of them\n" + " ".join(line)))
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_stage_keeps_columns_and_drops_emptied_documents(spark):
    line = "one two three four five six"
    rows = [(1, line, "en", "a", 27), (2, line, "en", "a", 27), (3, "", None, None, 0), (4, line + "\nmore", "x", "y", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_removed_lines", docs_marker())
    kept = linedup.deduped_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r.n_removed_lines) for r in kept.collect()) == [
        (1, line, 27, "mine"),
        (3, "", 0, "mine"),
        (4, "more", 4, "mine"),
    ]


def docs_marker():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_empty_table(spark):
    assert linedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_copy_stays_among_many_lines(spark):
    """Sets found twice among over 20,000 lines, with near copies between."""
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(6))) for i in range(20_500)]
    line = "one two three four five six seven eight nine"
    rows += [(30_000, line), (30_001, line), (30_002, "other " + line), (30_003, "other " + line), (30_004, line.upper())]
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    gone = {r.doc_id for r in found.filter("n_removed_lines > 0").collect()}
    assert gone == {30_001, 30_002, 30_003, 30_004}


def test_short_lines(spark):
    rows = [
        (1, "read more\nshare this page\none two three four"),
        (2, "Read  MORE\nshare that page\nfour three two one five\n\n \t"),
        (3, "more read read\nx\none two three six\n\n \t"),
        (4, "這是沒有空格的一段話\nx x x"),
        (5, "這是沒有空格的一段話\n" + "ha " * 300),
        (6, "ha"),
    ]
    found = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {
        1: rows[0][1],
        2: "share that page\n\n \t",
        3: "x\none two three six\n\n \t",
        4: "這是沒有空格的一段話",
        5: "ha " * 300,
        6: "",
    }


def test_rows_that_share_an_id(spark):
    """Different texts with no id, or one id, are told apart."""
    line = "one two three four five six"
    rows = [(-5, "first\n" + line), (None, "mine alone here\n" + line), (None, "other words stay\nunique words of this row"), (None, "third\nfurther words of the third")]
    rows += [(7, "seven\n" + line), (7, "eight\nstays where it is")]
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = [(i, t, 0) for i, t in rows]
    want[0], want[4] = (-5, "first", 1), (7, "seven", 1)
    assert got == sorted(want, key=repr)
    copies = linedup.dedup_lines(spark.createDataFrame([(None, line)] * 3, "doc_id long, text string"))
    assert sorted(r.n_removed_lines for r in copies.collect()) == [0, 1, 1]


def test_the_rarity_table_is_in_no_description_of_a_plan(spark):
    def described():
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {found.apply(i).executionId(): len(found.apply(i).physicalPlanDescription()) for i in range(found.size())}

    before, conf = described(), spark.conf.get("spark.sql.debug.maxToStringFields")
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "six five four three two one")], "doc_id long, text string")
    assert sorted(r.n_removed_lines for r in linedup.dedup_lines(docs).collect()) == [0, 1]
    new = [size for key, size in described().items() if key not in before]
    assert len(new) > 10 and max(new) < 200_000
    assert spark.conf.get("spark.sql.debug.maxToStringFields") == conf
