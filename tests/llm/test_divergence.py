"""The divergence audit against its SQL."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from deskmill.llm import divergence


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "naïve", "日本"]
    rows = []
    for i in range(260):
        source, lang = f"s{rng.choice('aaabcdé')}", rng.choice(["en", "en", "de"])
        start = 7 * ord(source[1]) % 40
        text = rng.choice([" ", "1", "; "]).join(rng.choices(words[start : start + 50] + words[-3:], k=rng.choice([0, 3, 40])))
        rows.append((text, lang, source))
    rows += [(rows[3][0], "en", rng.choice(["sa", "sb", "new"])) for _ in range(150)]  # one text, many copies
    rows += [(None, None, None), ("word", None, "sa"), ("", "fr", "sole"), ("x", "fr", "other"), (None, "en", "quiet")]
    rows += [("Worda wordA " * 20_000, "en", "sa")]
    rng.shuffle(rows)
    return rows


def by_sql(rows):
    con = duckdb.connect()
    docs = pd.DataFrame(rows, columns=["text", "lang", "source"])  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM docs")
    return sorted(con.sql(divergence.ORACLE_SQL).fetchall())


def found(df, **options):
    rows = divergence.audit(df, **options).collect()
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in rows)


@pytest.mark.parametrize("chunk", [12 << 20, 300])
def test_equals_sql(spark, monkeypatch, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = rows_of(chunk)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = by_sql(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[5] == 1 and r[4] > 0 for r in want)
    assert found(df) == want


def test_texts_are_counted_once_with_their_copies(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "text string, lang string, source string").na.fill("")
    texts = divergence.collapsed(df).collect()
    assert len(texts) == len({(t or "", lang or "") for t, lang, _ in rows})
    assert sum(s.n for r in texts for s in r.sources) == len(rows)


def test_slots_taken_for_another_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLOTS", 64)
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(df) == by_sql(rows)


def test_empty_and_clashing_columns(spark):
    schema = "n long, text string, lang string, source string, term string, p0 long"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", "en", s, "t", 3) for s in "ab"]
    assert found(spark.createDataFrame(rows, schema)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
