"""Admission in arrival order, against a plain loop."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F
from test_availability import APPOINTMENT, REQUEST, clash, random_calendar

from deskmill.operators import booking
from deskmill.operators.booking import _in_islands, _open_slots, accept, admit, appointment_rows, book
from deskmill.operators.ids import assign_ids
from deskmill.sources.tables import append_bookings, load_appointments

TITLED = REQUEST + ", title string"


def loop(requests, appointments):
    """Served one by one, as a single calendar desk would."""
    taken = [
        (a[0], a[1], a[2], a[3], a[4]) for a in appointments if a[5] not in (None, "cancelled")
    ]
    next_id = max([a[0] for a in appointments], default=0)
    outcome = {}
    for rid, cal, _, S, minutes, title in sorted(requests, key=lambda r: (r[2], r[0])):
        E = S + timedelta(minutes=minutes)
        hits = sorted((t[0], t[2]) for t in taken if t[1] == cal and clash(S, E, t[3], t[4]))
        if hits:
            outcome[rid] = (None, hits)
        else:
            next_id += 1
            taken.append((next_id, cal, title, S, E))
            outcome[rid] = (next_id, [])
    return outcome


def titled(requests):
    return [(*r, f"r{r[0]}") for r in requests]


@pytest.mark.parametrize("seed", [3, 4])
def test_matches_the_loop(spark, seed):
    requests, appointments = random_calendar(seed, 200, 60, hot=0.5)
    requests = titled(requests)
    expected = loop(requests, appointments)
    found = book(
        spark.createDataFrame(requests, TITLED), spark.createDataFrame(appointments, APPOINTMENT)
    ).collect()
    assert len(found) == len(requests)
    for row in found:
        got = (row.appointment_id, [(c.id, c.title) for c in row.conflicts])
        assert got == expected[row.request_id]
        assert row.success == (row.appointment_id is not None)


@pytest.mark.parametrize(
    "fold, batch, share",
    [(200, 200_000, 0.3), (1, 200_000, 0.3), (1, 200_000, 0), (1, 7, 1.1), (3, 20, 1.1), (3, 20, 0.5)],
)
def test_large_islands_take_rounds_and_agree(spark, fold, batch, share):
    """One hot calendar whose slots all hang together, settled in every way."""
    rnd = random.Random(9)
    requests = [
        (i, 0 if i % 3 else 1, at(8) + timedelta(seconds=rnd.randrange(9000)),
         at(0) + timedelta(minutes=5 * rnd.randrange(400)), rnd.choice([-10, 0, 20, 45, 90, 240]), "x")
        for i in range(220)
    ]
    df = spark.createDataFrame(requests, TITLED)
    none = spark.createDataFrame([], APPOINTMENT)
    won = admit(_open_slots(df, none), fold, batch, share)
    expected = {rid for rid, (aid, _) in loop(requests, []).items() if aid is not None}
    assert {r.request_id for r in won.collect()} == expected


def test_equal_slots_go_to_the_earliest(spark):
    requests = [(i, 1, at(8, i % 60), at(10), 60, "x") for i in range(300, 0, -1)]
    slots = _open_slots(
        spark.createDataFrame(requests, TITLED), spark.createDataFrame([], APPOINTMENT)
    )
    assert slots.count() == 1
    winner = min(requests, key=lambda r: (r[2], r[0]))[0]
    assert [r.request_id for r in admit(slots).collect()] == [winner]


def test_touching_slots_are_separate_islands(spark):
    requests = [(i, 1, at(8), at(10 + i), 60, "x") for i in range(5)]
    slots = _open_slots(
        spark.createDataFrame(requests, TITLED), spark.createDataFrame([], APPOINTMENT)
    )
    assert _in_islands(slots).select("island").distinct().count() == 5


def test_message_and_defaults(spark, tmp_path):
    requests = spark.createDataFrame(
        [(1, 1, at(8), at(15, 5), 60, "a", ["x@example.com"]), (2, 1, at(9), at(15), 30, "b", None),
         (3, 1, at(9, 1), at(18), 30, "c", None)],
        TITLED + ", attendees array<string>",
    )
    appointments = spark.createDataFrame([(40, 2, "x", at(1), at(2), "cancelled")], APPOINTMENT)
    rows = {r.request_id: r for r in book(requests, appointments).collect()}
    assert rows[1].message == "Booked for March 01 at 03:05 PM"
    assert rows[2].message == booking.NOT_AVAILABLE
    assert [(c.id, c.title) for c in rows[2].conflicts] == [(41, "a")]
    path = str(tmp_path / "appointments")
    append_bookings(appointment_rows(accept(requests, appointments)), path)
    stored = load_appointments(spark, path).orderBy("id").collect()
    assert [(s.id, s.title, s.description, s.attendees, s.status, s.created_by) for s in stored] == [
        (41, "a", "", ["x@example.com"], "confirmed", "system"),
        (42, "c", "", [], "confirmed", "system"),
    ]
    assert stored[0].end == at(16, 5)


def test_accepted_never_conflict(spark, sf_dir):
    from deskmill.plans import views

    ev = views.events(spark, sf_dir)
    won = accept(views.requests(ev), views.appointments(ev)).select(
        "calendar_id", F.unix_micros("start").alias("s"), "duration_minutes", "request_id"
    ).collect()
    spans = [(r.calendar_id, r.s, r.s + r.duration_minutes * 60_000_000) for r in won]
    for i, (cal, s, e) in enumerate(spans):
        for cal2, s2, e2 in spans[i + 1:]:
            assert cal != cal2 or not (s2 < e and e2 > s)


def test_ids_follow_the_order(spark):
    rows = spark.range(5000).selectExpr("id AS n", "(id * 7919) % 5000 AS rank").repartition(7)
    known = spark.createDataFrame([(17,)], "id bigint")
    found = assign_ids(rows, known, ["rank"]).collect()
    assert all(r.id == 18 + r.rank for r in found) and len(found) == 5000
