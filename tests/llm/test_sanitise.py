"""Personal data spans against a plain restatement of the patterns; disclosing terms."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from deskmill.llm import sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            d *= 1 + i % 2
            total += d - 9 * (d > 9)
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def expected(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return sorted(spans)


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


TEXTS = [
    None,
    "",
    "write to a.b+c@ex-ample.co.uk, or x@y, x@y.z_q@w.vu",
    "ip 1.2.3.4 and 256.1.1.1, 1.2.3.4.5.6.7.8 000255.01.1.0 1.2.3 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (555) 123-4567, +49.30.1234567890123456, +33123456789 +1-",
    "ééé 😀 +1 (743) 555-3824 😀 a@b.cd 227.5.221.1",
    "a" * 30_000 + "@" + "b." * 5_000 + "c",
    "1 " * 3_000,
    "4111111111111111 4111111111111111",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = ["a@b.c", ".", "1", "4111111111111111", "+1", " ", "-", "é", "192.168.0.1", "@", "(555)", "x", "37828224631000", "5"]
    return TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)]


def test_base_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    report = sanitise.span_report(sanitise.find_personal_data(df))
    found = {r.doc_id: r for r in report.collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans = expected(text)
        assert found[i].spans == shown(spans), text
        assert found[i].base_sha256 == hashlib.sha256(shown(spans).encode()).hexdigest()
        for rank, kind in enumerate(sanitise.KINDS):
            assert found[i][f"n_{kind}"] == sum(s[1] == rank for s in spans)


def test_disclosing_terms(spark):
    rows = [(i, f"Doc {i} filler{i} word says Zanzibarov, reach {'jo@ex.com'} soon number{i} thing{i}") for i in range(6)]
    rows += [(10 + i, f"plain talk about weather and soon says word number {i}") for i in range(200)]
    rows += [(300 + i, "one copied text near kopirka bo@ex.com here") for i in range(50)]
    rows += [(400, "Only Zanzibarov. is named; Zanzibarov")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    limits = sanitise.Thresholds(min_share=0.8)
    spanned = sanitise.find_personal_data(df, limits=limits)
    reports = {r.doc_id: r.spans for r in sanitise.span_report(spanned).collect()}
    # Named with the address in six surroundings, and hardly anywhere else.
    assert reports[400] == "term:5:15,term:27:37"
    assert reports[0].startswith("term:") and "email" in reports[0]
    # Fifty copies are one surrounding; common words reveal nothing.
    assert reports[300] == "email:29:38" and reports[10] == ""
    texts = {r.doc_id: r.sanitised for r in sanitise.sanitised(spanned).collect()}
    assert texts[400] == "Only [EMAIL-RELATED]. is named; [EMAIL-RELATED]"
    assert texts[300] == "one copied text near kopirka [EMAIL] here"
    assert texts[10] == rows[6][1]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sanitise.span_report(sanitise.find_personal_data(empty)).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "1.1.1.1")], "doc_id long, text string")
    found = sanitise.span_report(sanitise.find_personal_data(twice.withColumn("base", F.lit(1))))
    assert sorted(r.spans for r in found.collect()) == ["email:0:6", "email:0:6", "ip:0:7"]


def test_rows_that_share_an_id(spark):
    rows = [(None, f"Doc {i} filler{i} word says Zanzibarov, reach {'jo@ex.com'} soon number{i} thing{i}") for i in range(6)]
    rows += [(None if i % 2 else i, f"plain talk about weather and soon says word number {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    done = sanitise.sanitised(sanitise.find_personal_data(df)).collect()
    assert len(done) == len(rows)
    assert not [r for r in done if "Zanzibarov" in r.sanitised]
    assert sum("weather" in r.sanitised for r in done) == 200


def test_text_of_very_many_matches(spark):
    """200,000 addresses in one text: positions in near-linear time and bounded memory."""
    parts = [f"u{i}@ex.com" for i in range(200_000)]
    text = "é😀 " + " ".join(parts)
    df = spark.createDataFrame([(1, text), (2, "+4930123456789 " * 30_000)], "doc_id long, text string")
    spanned = sanitise.find_personal_data(df)
    found = {r.doc_id: r for r in sanitise.span_report(spanned).collect()}
    at, spans = 3, []
    for part in parts:
        spans.append(f"email:{at}:{at + len(part)}")
        at += len(part) + 1
    assert found[1].spans == ",".join(spans) and found[2].n_phone == 30_000
    done = {r.doc_id: r.sanitised for r in sanitise.sanitised(spanned).collect()}
    assert done[1] == "é😀 " + " ".join(["[EMAIL]"] * len(parts))
    assert done[2] == "[PHONE] " * 30_000


def test_overlapping_spans_become_one(spark):
    # The card's digits reach into the phone number's; nothing of either is left.
    text = "x 4111 1111 1111 1111.+1234567890 y 1.2.3.4@ex.com z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = sanitise.sanitised(sanitise.find_personal_data(df)).collect()
    assert row.sanitised == "x [CARD].[PHONE] y [EMAIL] z"


BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def term_of(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()


def brute_terms(texts, limits):
    """Disclosing terms by the definition, all pairs of all documents."""
    words, mentions = [], []
    for text in texts:
        spans = expected(text)
        bare = list(text)
        for s, _, e, _ in spans:
            bare[s:e] = " " * (e - s)
        words.append({term_of(w) for w in re.split(f"[{BLANK}]+", "".join(bare))} - {""})
        w = limits.surrounding_chars
        around = {}
        for s, _, e, kind in spans:
            around.setdefault((text[s:e].lower(), kind), set()).add((text[max(0, s - w) : s], text[e : e + w]))
        mentions.append(around)
    found = {}
    for entity in {x for m in mentions for x in m}:
        holders = [i for i, m in enumerate(mentions) if entity in m]
        for term in {t for i in holders for t in words[i]}:
            both = [i for i in holders if term in words[i]]
            # One surrounding per document here, so which one a document is known by is plain.
            contexts = {next(iter(mentions[i][entity])) for i in both}
            share = len(both) / sum(term in w for w in words)
            bits = math.log2(share * len(texts) / len(holders))
            if len(contexts) >= limits.min_contexts and share >= limits.min_share and bits >= limits.min_bits:
                found[term] = max(found.get(term, (0, 0, "")), (share, bits, entity[1]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_against_brute_force(spark, seed):
    rng = random.Random(seed)
    people = [("Wu", "wu@ex.com"), ("K7", "+4930123456789"), ("李雷", "li@ex.com"), ("Zanzibarov", "10.0.0.7"), ("Ann", "ann@ex.com")]
    texts = []
    for i in range(400):
        said = [rng.choice(["the", "rain", "in", "Spain,", "falls", "mainly", "x1", "on"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.15:
            name, value = rng.choice(people)
            if rng.random() < 0.9:
                said.insert(0, f"({name})")
            said += ["far"] * rng.choice([0, 2_000]) + [rng.choice(["call", "mail", "see", "ask"]), value]
        elif rng.random() < 0.02:
            said.append(rng.choice(people)[0])
        texts += [" ".join(said)] * rng.choice([1, 1, 1, 4])
    limits = sanitise.Thresholds(min_bits=2.0, min_share=0.4)
    want = brute_terms(texts, limits)
    assert {"wu", "k7", "李雷"} & set(want)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spotted = sanitise.durable(sanitise.with_base_spans(df.withColumn("doc", F.col("doc_id"))))
    terms, held = sanitise.disclosing_terms(spotted, limits)
    got = {r.term: (r.share, r.bits, r.kind) for r in terms.collect()}
    assert got.keys() == want.keys()
    for term, (share, bits, kind) in want.items():
        assert got[term] == (pytest.approx(share), pytest.approx(bits), kind)
    assert {r.doc for r in held.filter(F.col("term") == "wu").collect()} == {
        i for i, t in enumerate(texts) if re.search(r"\bWu\b", t)
    } or "wu" not in want


def test_a_name_far_from_the_address(spark):
    rows = [(i, f"Zanzibarov {'word ' * 1_000} tell{i} jo@ex.com now{i}") for i in range(5)]
    rows += [(100 + i, f"word tell and now {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = {r.doc_id: r.sanitised for r in sanitise.sanitised(sanitise.find_personal_data(df)).collect()}
    assert all("Zanzibarov" not in done[i] and "jo@" not in done[i] and "word word" in done[i] for i in range(5))
    assert done[100] == "word tell and now 0"
