"""Whole turns: prompts that carry the intent before, against a plain loop."""

from __future__ import annotations

import random
import sys
from datetime import timedelta

import pytest
from conftest import at
from pyspark import cloudpickle

from deskmill.operators.turns import _prompt, _read, process_text, understand

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN = (
    "request_id bigint, event_id bigint, calendar_id bigint, session_id string, ts timestamp,"
    " text string, use_cloud boolean, user_consent boolean"
)


def counting(prompt):
    """Counts how far a session has come, by what the prompt says of the turn before."""
    if "fail" in prompt.split('Request: "')[1].split("\n")[0]:
        raise RuntimeError("down")
    before = prompt.split("Previous intent: ")[1].split("\n")[0] if prompt.startswith("Previous") else ""
    n = int(before.split("'n': ")[1].split(",")[0]) + 1 if "'n': " in before else 1
    cloudy = "cloud: " in prompt
    return f'so {{"intent": "step", "n": {n}, "cloudy": "{cloudy}"}}'


def local():
    return lambda prompt: counting(prompt)


def local_batched():
    def model(prompts):
        if len(prompts) % 3 == 0:
            raise RuntimeError("too many")
        return [counting(p) for p in prompts]

    return model


def cloud():
    return lambda prompt: None if "silence" in prompt else f"cloud: {prompt}"


def cloud_batched():
    return lambda prompts: [None if "silence" in p else f"cloud: {p}" for p in prompts]


def by_loop(rows):
    """``(heard, record, last record)`` per turn."""
    records, out = {}, {}
    for rid, event, _, session, ts, text, use_cloud, consent in sorted(rows, key=lambda r: (r[4], r[1])):
        last = records.get(session) if session else None

        def meant(said):
            lowered = (said or "").lower()
            rule = {"intent": "book_appointment", "confidence": 0.5} if "book" in lowered else {"intent": "unknown", "confidence": 0.3}
            if said is None:
                return rule
            try:
                return {**_read(counting(_prompt(said, last))), "confidence": 0.8}
            except RuntimeError:
                return rule

        now, heard = meant(text), text
        if use_cloud and consent and text is not None and now["confidence"] < 0.7 and "silence" not in text:
            heard = f"cloud: {text}"
            now = {**meant(heard), "source": "cloud"}
        out[rid] = (heard, str(now), last)
        if session:
            records[session] = str(now)
    return out


def rows_of(seed):
    rnd = random.Random(seed)
    texts = ["hi"] * 9 + ["fail", "book, fail", "fail silence", None, "fail mail a.b@c.de"]
    return [
        (i, i, 1, rnd.choice(["hot"] * 6 + ["a", "b", "c", None, ""]), at(0) + timedelta(minutes=rnd.randrange(60)),
         rnd.choice(texts), rnd.choice([True, False, None]), rnd.choice([True, True, False, None]))
        for i in range(240)
    ]


@pytest.mark.parametrize("batched", [False, True])
def test_prompts_carry_the_intent_before(spark, batched):
    rows = rows_of(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        models = (local_batched, cloud_batched) if batched else (local, cloud)
        df = spark.createDataFrame(rows, TURN).repartition(5)
        found = understand(df, *models, {"openai"}, batched=batched).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = by_loop(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.heard, r.record, r.last_record) == want[r.request_id]
        assert (r.source == "cloud") == (r.heard or "").startswith("cloud")
    # failures break the count, so it shows that turns were asked one after the other
    assert any("'n': 4" in r.record for r in found)


@pytest.mark.parametrize("configured, enabled", [((), True), (("openai",), False)])
def test_nothing_leaves_without_leave(spark, configured, enabled):
    rows = [(1, 1, 1, "a", at(8), "fail", True, True)]

    def never():
        def model(_):
            raise AssertionError("asked")

        return model

    (row,) = understand(spark.createDataFrame(rows, TURN), local, never, configured, enabled).collect()
    assert row.source is None and row.record == "{'intent': 'unknown', 'confidence': 0.3}"


def test_replies_and_context(spark):
    rows = [(1, 1, 1, "s", at(8), "hi", False, True), (2, 2, 1, "s", at(9), "fail book", False, True), (3, 3, 1, None, at(9), "hi", False, True)]
    none = "id bigint, calendar_id bigint, title string, start timestamp, end timestamp, status string"
    done = process_text(
        spark.createDataFrame(rows, TURN), spark.createDataFrame([], none), spark.createDataFrame([], "task_id bigint"), local, cloud
    )
    found = {r.request_id: r for r in done.collect()}
    assert found[1].last_intent is None and found[3].last_intent is None
    assert found[2].last_intent == "{'intent': 'step', 'n': 1, 'cloudy': 'False', 'confidence': 0.8}"
    assert found[2].last_response == found[1].response
    assert (found[2].intent, found[2].confidence) == ("book_appointment", 0.5)


@pytest.mark.parametrize(
    "reply, kept",
    [("x", "text"), ("}{", "text"), ("{1}", "raw"), ('{"a": 1} {', "raw"), ("[" * 10 + "{" * 99_999 + "}", "raw"), ('{"a": 1}', None)],
)
def test_read(reply, kept):
    if reply == '{"a": 1} {':
        assert _read(reply) == {"a": 1}
    else:
        assert _read(reply) == ({"a": 1} if kept is None else {"intent": "unknown", kept: reply})
