"""Intents, replies, context, validation, inference."""

from __future__ import annotations

import json
import random
import re
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from deskmill.functions import intents
from deskmill.functions.text import strip
from deskmill.functions.times import iso, parse_iso
from deskmill.operators import dispatch as dp
from deskmill.operators import gates, inference, sessions, validate
from deskmill.operators.resolve import resolve_intents


@pytest.mark.parametrize(
    "text, intent, confidence",
    [
        ("freedom!", "check_availability", 0.5),
        ("book a free task", "check_availability", 0.5),
        ("SCHEDULE", "book_appointment", 0.5),
        ("my ToDo", "create_task", 0.5),
        ("hello", "unknown", 0.3),
        ("", "unknown", 0.3),
    ],
)
def test_rules(spark, text, intent, confidence):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(intents.rule_intent(F.col("t")).alias("r")).first().r) == (intent, confidence)


# Reply, intent, names of the entities, and where the whole reply is kept, if it is.
REPLIES = [
    ("no braces here", "unknown", None, "text"),
    ('{"intent": "a"}', "a", ["intent"], None),
    ('Sure! {"intent": "a", "title": "x {y}"} done', "a", ["intent", "title"], None),
    ('{"intent": "a"} {"b": 2}', "unknown", None, "raw"),
    ('{"intent": "a"}junk}', "unknown", None, "raw"),
    ("{'intent': 'a'}", "unknown", None, "raw"),
    ("{intent: 1}", "unknown", None, "raw"),
    ('{"intent": "a", "intent": "b"}', "b", ["intent"], None),
    ('{\n "intent": "a",\n "list": [1, {"k": "v"}]\n}', "a", ["intent", "list"], None),
    ('{"intent": "a"', "unknown", None, "text"),
    ("} before {", "unknown", None, "text"),
    ("{}", None, [], None),
    ("", "unknown", None, "text"),
    ('{"intent": "a"},{"intent": "b"}', "unknown", None, "raw"),
    ('{"intent": null}', None, ["intent"], None),
    ("{" * 50, "unknown", None, "text"),
]


def test_json_edges(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, reply string")
    for row in intents.parse_replies(df, "reply").collect():
        reply, intent, names, kept = REPLIES[row.i]
        parsed = row.parsed
        assert (parsed.intent, parsed.confidence) == (intent, 0.8)
        assert (None if parsed.entities is None else sorted(parsed.entities)) == names
        assert parsed.text == (reply if kept == "text" else None)
        assert parsed.raw == (reply if kept == "raw" else None)


def test_prompt(spark):
    df = spark.createDataFrame([("hi", None), ("hi", "{'intent': 'x', 'confidence': 0.3}")], "t string, p string")
    bare, led = [r[0] for r in df.select(intents.build_prompt(F.col("t"), F.col("p"))).collect()]
    assert led == "Previous intent: {'intent': 'x', 'confidence': 0.3}\n" + bare
    assert 'Request: "hi"\n\nJSON output:\n{\n    "intent"' in bare and "{{" not in bare


def _replies(spark, rows):
    df = spark.createDataFrame(rows, "request_id bigint, calendar_id bigint, arrival timestamp, reply string")
    return intents.parse_replies(df, "reply").select("request_id", "calendar_id", "arrival", "parsed.*")


def test_dispatch(spark):
    cases = [
        ('{"intent": "check_availability"}', None, dp.NEED_DATETIME),
        ('{"intent": "check_availability", "datetime": ""}', None, dp.NEED_DATETIME),
        ('{"intent": "check_availability", "datetime": null}', None, dp.NEED_DATETIME),
        ('{"intent": "check_availability", "datetime": "x"}', "check", None),
        ('{"intent": "book_appointment"}', None, dp.NEED_DETAILS),
        ('{"intent": "book_appointment", "datetime": "x"}', "book", None),
        ('{"intent": "create_task"}', None, dp.NEED_DETAILS),
        ('{"intent": "create_task", "title": "t"}', "task", None),
        ('{"intent": "cancel_appointment"}', None, dp.NOT_SURE),
        ('{"title": "t"}', None, dp.NOT_SURE),
        ("prose", None, dp.NOT_SURE),
    ]
    df = _replies(spark, [(i, 1, at(8), c[0]) for i, c in enumerate(cases)])
    for row in dp.dispatch(df).collect():
        assert (row.action, row.response) == cases[row.request_id][1:]


def test_dispatch_calendar_in_arrival_order(spark):
    ask = '{"intent": "check_availability", "datetime": "2024-03-02T10:00:00"%s}'
    take = '{"intent": "book_appointment", "datetime": "2024-03-02T10:00:00"%s}'
    rows = [
        (1, 1, at(8), ask % ""),
        (2, 1, at(9), take % ""),
        (3, 1, at(10), ask % ""),
        (4, 1, at(11), take % ', "title": "late"'),
        (5, 1, at(12), take.replace("2024-03-02", "soon") % ""),
        (6, 1, at(12), ask % ', "duration": "long"'),
        (7, 1, at(12), ask.replace("10:00", "11:00") % ', "duration_minutes": 600'),
        (8, 2, at(12), ask % ""),
    ]
    none = spark.createDataFrame(
        [], "id bigint, calendar_id bigint, title string, start timestamp, end timestamp, status string"
    )
    found = {
        r.request_id: r.response
        for r in dp.dispatch_calendar(dp.dispatch(_replies(spark, rows)), none).collect()
    }
    yes = dp.IS_AVAILABLE.format("2024-03-02T10:00:00")
    assert found == {
        1: yes,
        2: "Booked for March 02 at 10:00 AM",
        3: dp.HOW_ABOUT.format("2024-03-02T11:00:00"),
        4: "Slot not available",
        5: dp.FAILED,
        6: dp.FAILED,
        7: dp.IS_AVAILABLE.format("2024-03-02T11:00:00"),
        8: yes,
    }


def test_duration_minutes_option(spark):
    df = dp.dispatch(_replies(spark, [(1, 1, at(8),
        '{"intent": "check_availability", "datetime": "2024-03-02", "duration_minutes": 30}')]))
    assert dp.calendar_calls(df).first().duration_minutes == 60
    assert dp.calendar_calls(df, accept_duration_minutes=True).first().duration_minutes == 30


def test_resolve(spark):
    local = spark.createDataFrame(
        [(1, "unknown", 0.3, None, True), (2, "unknown", 0.3, None, False),
         (3, "x", 0.8, None, True), (4, "unknown", 0.3, None, True), (5, "unknown", 0.3, None, True)],
        "request_id bigint, intent string, confidence double, entities map<string,string>, use_cloud boolean",
    )
    cloud = spark.createDataFrame(
        [(i, '{"intent": "book_appointment"}') for i in (1, 2, 3)] + [(5, None)], "request_id bigint, reply string"
    )
    rows = {r.request_id: (r.intent, r.confidence, r.source) for r in resolve_intents(local, cloud).collect()}
    assert rows[1] == ("book_appointment", 0.8, "cloud")
    assert rows[2] == rows[4] == rows[5] == ("unknown", 0.3, None)
    assert rows[3] == ("x", 0.8, None)


def test_context_of_a_hot_session(spark):
    rnd = random.Random(2)
    rows = [
        (i, rnd.choice(["hot"] * 5 + ["a", "b", None, ""]), at(0) + timedelta(minutes=rnd.randrange(12000)),
         f"i{i}", f"r{i}")
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "event_id bigint, session_id string, ts timestamp, intent string, response string")
    found = {r.event_id: (r.prev_intent, r.prev_response) for r in sessions.with_context(df).collect()}
    last = {}
    for i, session, _, intent, response in sorted(rows, key=lambda r: (r[2], r[0])):
        assert found[i] == (last.get(session, (None, None)) if session else (None, None))
        if session:
            last[session] = (intent, response)
    assert len(found) == len(rows)


def test_speech_gates(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "hi")], "i int, speech_result string")
    silent, spoken = gates.split_silent(df)
    assert {r.i: r.reply for r in silent.collect()} == dict.fromkeys((1, 2), gates.REPROMPT)
    assert [r.i for r in spoken.collect()] == [3, 4]
    texts = [" \t hi there \n", "  ", None, " x　", "\x1cy\x1f", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "transcript string")
    for row in gates.gate_transcripts(df).collect():
        want = (row.transcript or "").strip()
        assert (row.text, row.error) == ((want, None) if want else (None, gates.NO_TRANSCRIPT))
    assert df.select(strip(F.col("transcript"))).count() == len(texts)


@pytest.mark.parametrize(
    "text, parsed",
    [
        ("2024-03-01T15:00:00", at(15)),
        ("2024-03-01 15:00", at(15)),
        ("2024-03-01T15", at(15)),
        ("2024-03-01", at(0)),
        ("2024-03-01T15:00:00Z", at(15)),
        ("2024-03-01T15:00:00+02:00", at(13)),
        ("2024-03-01T15:00:00.250000", at(15) + timedelta(milliseconds=250)),
        ("2024-13-01", None),
        ("2024-02-30", None),
        ("2024", None),
        ("15:00", None),
        ("20240301T150000", None),
        ("2024-03-01T25:00", None),
        (" 2024-03-01", None),
        ("2024-03-01\n", None),
        ("tomorrow", None),
        (None, None),
    ],
)
def test_iso(spark, text, parsed):
    df = spark.createDataFrame([(text,)], "t string").select(parse_iso(F.col("t")).alias("t"))
    row = df.select("t", iso(F.col("t")).alias("back")).first()
    assert row.t == parsed
    assert row.back == (parsed.isoformat() if parsed else None)


def test_booking_forms(spark):
    forms = [
        ('{"start_datetime": "2024-03-01"}', validate.MISSING),
        ('{"title": "a"}', validate.MISSING),
        ('{"title": "a", "start_datetime": "x"}', validate.BAD_DATETIME),
        ('{"title": "a", "start_datetime": null}', validate.BAD_DATETIME),
        ('{"title": "a", "start_datetime": "2024-03-01", "duration": null}', validate.BAD_DURATION),
        ("[]", validate.BAD_BODY),
        ('{"title": "", "start_datetime": "2024-03-01T10:00"}', None),
        ('{"title": "a", "start_datetime": "2024-03-01", "duration": -5, "attendees": ["x", "y"]}', None),
    ]
    df = spark.createDataFrame(list(enumerate(f for f, _ in forms)), "i int, payload string")
    rows = {r.i: r for r in validate.validate_bookings(df).collect()}
    assert [rows[i].reject_reason for i in range(len(forms))] == [reason for _, reason in forms]
    assert (rows[6].title, rows[6].start, rows[6].duration_minutes, rows[6].attendees) == ("", at(10), 60, [])
    assert (rows[7].duration_minutes, rows[7].attendees) == (-5, ["x", "y"])


def test_availability_forms(spark):
    df = spark.createDataFrame([("2024-03-01", None), ("x", 5)], "datetime_str string, duration int")
    good, bad = validate.validate_availability(df).collect()
    assert (good.start, good.duration_minutes, good.reject_reason) == (at(0), 60, None)
    assert (bad.start, bad.duration_minutes, bad.reject_reason) == (None, 5, validate.BAD_DATETIME_FORMAT)


def test_inference_falls_back_per_row(spark):
    def load():
        def model(prompt):
            if "fail" in prompt:
                raise ValueError("down")
            return '{"intent": "create_task", "title": "t"}'

        return model

    df = spark.createDataFrame([(1, "book it"), (2, "book, fail")], "i int, text string")
    df = df.withColumn("prompt", F.col("text"))
    rows = {r.i: r for r in inference.intents_with_fallback(inference.infer(df, load)).collect()}
    assert (rows[1].intent, rows[1].confidence, rows[1].origin) == ("create_task", 0.8, "model")
    assert (rows[2].intent, rows[2].confidence, rows[2].origin) == ("book_appointment", 0.5, "rule")


def test_each_distinct_prompt_is_asked_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(prompt):
            calls.add(1)
            if prompt == "fail":
                raise ValueError("down")
            return prompt.upper()

        return model

    rows = [(i, rnd) for i, rnd in enumerate(["hot"] * 300 + ["a", "b", "fail", "fail", None, "", "a"])]
    df = spark.createDataFrame(rows, "i int, prompt string").repartition(6)
    answered = inference.infer(df, load)
    found = {r.i: r.reply for r in answered.collect()}
    assert answered.count() == len(rows) == len(found)
    assert calls.value == 5  # hot, a, b, fail and the empty one, however often they are read
    assert all(found[i] == (None if p in (None, "fail") else p.upper()) for i, p in rows)
