"""Masking: stated results for literal rows, properties for random ones."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from deskmill.functions.crypto import decrypt_col, derive_key, encrypt_col
from deskmill.functions.pii import mask_pii, pii_entries, unmask
from deskmill.operators.gates import choose_provider, consent_gate, needs_cloud, outbound

# The three patterns.
PATTERNS = {
    "EMAIL": r"\b[\w\.-]+@[\w\.-]+\.\w+\b",
    "PHONE": r"\b\+?[\d\-\(\)]{10,}\b",
    "NAME": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
}


# Text, masked text, and the originals in the order of their numbers.
EDGES = [
    ("mail réné.dupé@exé.com now", "mail [EMAIL_0] now", ["réné.dupé@exé.com"]),
    ("éAbc Defé and Abc Def", "éAbc Defé and [NAME_0]", ["Abc Def"]),
    ("call 555-123-4567 or +33123456789", "call [PHONE_0] or +[PHONE_1]", ["555-123-4567", "33123456789"]),
    ("x+33123456789 (555)1234567", "x[PHONE_0] ([PHONE_1]", ["+33123456789", "555)1234567"]),
    ("4111111111111111", "[PHONE_0]", ["4111111111111111"]),
    ("John Smith met John Smith", "[NAME_0] met [NAME_1]", ["John Smith", "John Smith"]),
    ("", "", []),
    ("a.b-c@d.e-f.org, q@r.s", "[EMAIL_0], [EMAIL_1]", ["a.b-c@d.e-f.org", "q@r.s"]),
    (
        "Jane Doe <jane.doe@example.com> 0123456789 Jane Doe",
        "[NAME_2] <[EMAIL_0]> [PHONE_1] [NAME_3]",
        ["jane.doe@example.com", "0123456789", "Jane Doe", "Jane Doe"],
    ),
    ("no@dots, @x.y, a@b.c.", "no@dots, @x.y, [EMAIL_0].", ["a@b.c"]),
    ("Élan Vital Abc Déf Abc Def²", "Élan [NAME_0] Déf Abc Def²", ["Vital Abc"]),
    ("tel ٠١٢٣٤٥٦٧٨٩ ok", "tel [PHONE_0] ok", ["٠١٢٣٤٥٦٧٨٩"]),
    ("½0123456789 ²a@b.cd é@è.à", "½0123456789 [EMAIL_0] [EMAIL_1]", ["²a@b.cd", "é@è.à"]),
    (
        "line\nbreak Ann Lee\nBob Ray 12-34-56-78-9(0)1",
        "line\nbreak [NAME_1]\n[NAME_2] [PHONE_0]",
        ["12-34-56-78-9(0)1", "Ann Lee", "Bob Ray"],
    ),
]

PLACEHOLDER = re.compile(r"\[(EMAIL|PHONE|NAME)_(\d+)\]")


def check_properties(text, masked, mapping):
    """What holds for any text that holds no placeholder of its own."""
    kinds = [PLACEHOLDER.fullmatch(key).groups() for key in mapping]
    # Numbers run through; e-mails come first, then phones, then names.
    assert [int(n) for _, n in kinds] == list(range(len(mapping)))
    assert [k for k, _ in kinds] == sorted((k for k, _ in kinds), key=list(PATTERNS).index)
    # Each placeholder stands once, in the order of the numbers within its kind.
    found = PLACEHOLDER.findall(masked)
    assert sorted(found) == sorted(kinds)
    for kind in PATTERNS:
        assert [n for k, n in found if k == kind] == [n for k, n in kinds if k == kind]
    for (kind, _), original in zip(kinds, mapping.values()):
        assert re.fullmatch(PATTERNS[kind], original)
    # Nothing is left to mask, but for matches that only masking made: those touch a placeholder.
    for pattern in PATTERNS.values():
        assert not re.search(pattern, PLACEHOLDER.sub("\n", masked))
    restored = PLACEHOLDER.sub(lambda m: mapping[m[0]], masked)
    assert restored == text


def test_literal_rows(spark):
    df = mask_pii(spark.createDataFrame([(i, e[0]) for i, e in enumerate(EDGES)], "i int, text string"), "text")
    for row in df.withColumn("e", F.map_entries("mapping")).collect():
        _, masked, originals = EDGES[row.i]
        assert row.masked == masked
        assert [e.value for e in row.e] == originals
        assert all(e.key.endswith(f"_{n}]") for n, e in enumerate(row.e))


def entries(row):
    return {e.key: e.value for e in row.e}


def test_random_text(spark):
    rnd = random.Random(11)
    bits = ["John", "Doe", "Ann", "é", "_", " ", " ", "@", ".", "-", "+", "(", ")", "0123", "4567", "89",
            "x", "ß", "²", "a@b.co", "\n", "Ω", "[", "]"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(600)]
    df = mask_pii(spark.createDataFrame(rows, "i int, text string"), "text")
    df = df.withColumn("back", unmask(F.col("masked"), F.col("mapping")))
    for row in df.withColumn("e", F.map_entries("mapping")).collect():
        assert row.back == row.text
        check_properties(row.text, row.masked, entries(row))


def test_null_and_literal_placeholder(spark):
    df = mask_pii(spark.createDataFrame([(None,), ("[EMAIL_0] a@b.cd",)], "text string"), "text")
    null, literal = df.collect()
    assert null.masked is None and null.mapping is None
    assert literal.masked == "[EMAIL_0] [EMAIL_0]"


def test_all_documents_match_and_restore(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = mask_pii(docs, "text").withColumn("back", unmask(F.col("masked"), F.col("mapping")))
    for row in df.withColumn("e", F.map_entries("mapping")).collect():
        assert row.back == row.text
        check_properties(row.text, row.masked, entries(row))


def test_entries(spark):
    df = mask_pii(spark.createDataFrame([(1, "Ann Lee, a@b.cd")], "i int, text string"), "text")
    rows = pii_entries(df.select("i", "mapping")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "[EMAIL_0]", "a@b.cd"), (1, 1, "[NAME_1]", "Ann Lee")]


@pytest.mark.parametrize(
    "wanted, confidence, escalates",
    [(True, 0.5, True), (True, 0.7, False), (True, None, False), (False, 0.1, False), (None, 0.1, False)],
)
def test_escalation(spark, wanted, confidence, escalates):
    df = spark.createDataFrame([(wanted, confidence)], "w boolean, c double")
    assert df.select(needs_cloud(F.col("w"), F.col("c"))).first()[0] is escalates


def test_consent_and_provider(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, user_consent boolean")
    assert [r.i for r in consent_gate(df, True).collect()] == [1]
    assert consent_gate(df, False).count() == 0
    for configured, chosen in [({"anthropic"}, "anthropic"), ({"anthropic", "openai"}, "openai"), ((), None)]:
        assert df.select(choose_provider(configured)).first()[0] == chosen


def test_outbound_leaks_nothing(spark, sf_dir):
    from deskmill.plans import views

    docs = views.outbound_input(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sent = outbound(docs, "doc_id", "text", {"openai"})
    assert sent.columns == ["doc_id", "provider", "prompt"]
    consented = {r.doc_id for r in docs.filter("user_consent").collect()}
    for row in sent.collect():
        assert row.doc_id in consented
        assert not any(re.search(pattern, row.prompt) for pattern in PATTERNS.values())
    assert outbound(docs, "doc_id", "text", set()).count() == 0


def test_encryption(spark):
    key = derive_key("secret", b"salt")
    assert len(key) == 32 and key != derive_key("secret", b"other")
    df = spark.createDataFrame([("täxt",), ("",), (None,)], "t string")
    sealed = df.select("t", encrypt_col(F.col("t"), key).alias("token"))
    for row in sealed.select("t", "token", decrypt_col(F.col("token"), key).cast("string").alias("b")).collect():
        assert row.b == row.t
        assert row.token is None or row.t is None or row.t.encode() not in bytes(row.token) or not row.t
    with pytest.raises(Exception):
        sealed.filter("t = 'täxt'").select(decrypt_col(F.col("token"), derive_key("x", b"salt"))).collect()


def test_every_text_comes_back(spark):
    rnd = random.Random(5)
    bits = ["[EMAIL_0]", "[PHONE_1]", "[LITERAL_0]", "[NAME_", "2]", "0123456789", "Ann Lee", "a@b.co", " ", "é", "[", "]", "_"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))) for i in range(500)]
    rows += [(1000, "a.b@c.de, " * 10_000), (1001, "[EMAIL_1] [NAME_0] Ann Lee " * 3000), (1002, None), (1003, "")]
    df = mask_pii(spark.createDataFrame(rows, "i int, text string"), "text", literals=True)
    for row in df.withColumn("back", unmask(F.col("masked"), F.col("mapping"))).collect():
        assert row.back == row.text
    # numbers that are no places, as in an answer that was made up, stay as they are
    odd = mask_pii(spark.createDataFrame([("Ann Lee",)], "text string"), "text")
    odd = odd.select(unmask(F.lit("[NAME_0] [NAME_7] [EMAIL_0]"), F.col("mapping")).alias("t")).first()
    assert odd.t == "Ann Lee [NAME_7] [EMAIL_0]"
