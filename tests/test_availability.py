"""Conflict boundaries, suggestions and the interval join, against plain Python."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import at

from deskmill.operators import availability as av
from deskmill.operators.intervals import label_islands, overlap_join

REQUEST = "request_id bigint, calendar_id bigint, arrival timestamp, start timestamp, duration_minutes int"
APPOINTMENT = "id bigint, calendar_id bigint, title string, start timestamp, end timestamp, status string"


def clash(S, E, s, e):
    return (s < E and e > S) or (s >= S and e <= E)


def random_calendar(seed, n_requests, n_appointments, calendars=3, hot=0.4, days=12):
    """Requests and appointments; calendar 0 holds a large share of both."""
    rnd = random.Random(seed)

    def calendar():
        return 0 if rnd.random() < hot else rnd.randrange(calendars)

    def moment():
        return at(0) + timedelta(minutes=15 * rnd.randrange(4 * 24 * days))

    requests = [
        (i, calendar(), moment(), moment(), rnd.choice([-60, -15, 0, 0, 15, 30, 60, 60, 90, 600, 50000]))
        for i in range(n_requests)
    ]
    appointments = []
    for i in range(n_appointments):
        start = moment()
        length = rnd.choice([-30, 0, 0, 15, 30, 60, 120, 60 * 30, 60 * 24 * 40])
        length = length if length < 2000 or rnd.random() < 0.1 else 45
        status = rnd.choice(["confirmed"] * 4 + ["cancelled", None])
        appointments.append(
            (i, calendar(), f"t{i}", start, start + timedelta(minutes=length), status)
        )
    return requests, appointments


def brute(requests, appointments, limit=3):
    active = [a for a in appointments if a[5] is not None and a[5] != "cancelled"]
    answer = {}
    for rid, cal, _, S, minutes in requests:
        E = S + timedelta(minutes=minutes)
        mine = [a for a in active if a[1] == cal]
        hits = sorted((a[0], a[2]) for a in mine if clash(S, E, a[3], a[4]))
        free = []
        if hits:
            for k in range(1, 168):
                s, e = S + timedelta(hours=k), E + timedelta(hours=k)
                if not any(a[3] < e and a[4] > s for a in mine):
                    free.append(s)
                if len(free) == limit:
                    break
        answer[rid] = (not hits, hits, free)
    return answer


@pytest.mark.parametrize(
    "start, end, conflict",
    [
        (at(9), at(10), False),
        (at(11), at(12), False),
        (at(10, 59), at(12), True),
        (at(10, 15), at(10, 30), True),
        (at(9), at(12), True),
        (at(10), at(10), True),
        (at(11), at(11), True),
        (at(10), at(11), True),
        (at(9, 30), at(9, 30), False),
    ],
)
def test_conflict_boundaries(spark, start, end, conflict):
    requests = spark.createDataFrame([(1, 1, at(8), at(10), 60)], REQUEST)
    appointments = spark.createDataFrame([(7, 1, "x", start, end, "confirmed")], APPOINTMENT)
    row = av.check_availability(requests, appointments).first()
    assert row.available is not conflict
    assert [c.id for c in row.conflicts] == ([7] if conflict else [])


def test_edge_points_conflict_but_leave_suggestions_free(spark):
    requests = spark.createDataFrame([(1, 1, at(8), at(9), 60)], REQUEST)
    appointments = spark.createDataFrame(
        [(1, 1, "now", at(9), at(10), "confirmed"), (2, 1, "point", at(11), at(11), "confirmed")],
        APPOINTMENT,
    )
    row = av.availability(requests, appointments).first()
    assert row.suggested_times == [at(10), at(11), at(12)]


@pytest.mark.parametrize("status", ["cancelled", None])
def test_inactive_never_conflicts(spark, status):
    requests = spark.createDataFrame([(1, 1, at(8), at(10), 60)], REQUEST)
    appointments = spark.createDataFrame([(7, 1, "x", at(10), at(11), status)], APPOINTMENT)
    assert av.conflict_pairs(requests, appointments).count() == 0
    assert av.not_cancelled(appointments).count() == 0


def test_fully_booked_week_gives_no_suggestion(spark):
    requests = spark.createDataFrame([(1, 1, at(8), at(10), 60)], REQUEST)
    appointments = spark.createDataFrame(
        [(7, 1, "x", at(0), at(0) + timedelta(days=9), "confirmed")], APPOINTMENT
    )
    row = av.availability(requests, appointments).first()
    assert (row.available, row.suggested_times) == (False, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    """Zero, negative and very long spans, a hot calendar, every edge."""
    requests, appointments = random_calendar(seed, 150, 120)
    expected = brute(requests, appointments)
    found = av.availability(
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame(appointments, APPOINTMENT)
    ).collect()
    assert len(found) == len(requests)
    for row in found:
        available, hits, free = expected[row.request_id]
        assert row.available == available
        assert [(c.id, c.title) for c in row.conflicts] == hits
        assert row.suggested_times == free


def test_bookings_are_seen_by_later_arrivals_only(spark):
    requests = spark.createDataFrame(
        [(1, 1, at(8), at(10), 60), (2, 1, at(9), at(10), 60)], REQUEST
    )
    none = spark.createDataFrame([], APPOINTMENT)
    booked = spark.createDataFrame(
        [(5, 1, "new", at(10), at(11), at(8, 30), 9)],
        "id bigint, calendar_id bigint, title string, start timestamp, end timestamp,"
        " since_ts timestamp, since_id bigint",
    )
    rows = {r.request_id: r for r in av.availability(requests, none, booked=booked).collect()}
    assert rows[1].available and not rows[2].available
    assert rows[2].suggested_times[0] == at(11)


def test_overlap_join_gives_each_pair_once(spark):
    rnd = random.Random(5)
    day = 86_400_000_000

    def spans(n):
        lengths = [0, 1, day // 3, day, 2 * day, 33 * day, 1500 * day]
        starts = [(rnd.randrange(3), rnd.randrange(-40 * day, 40 * day, day // 4)) for _ in range(n)]
        return [(i, k, s, s + rnd.choice(lengths)) for i, (k, s) in enumerate(starts)]

    left, right = spans(60), spans(60)
    a = spark.createDataFrame(left, "i bigint, k bigint, s bigint, e bigint")
    b = spark.createDataFrame(right, "j bigint, m bigint, t bigint, f bigint")
    met = overlap_join(a, b, ("k", "m"), ("s", "e"), ("t", "f"), "t <= e AND f >= s")
    pairs = sorted((r.i, r.j) for r in met.collect())
    expected = sorted(
        (i, j) for i, k, s, e in left for j, m, t, f in right if k == m and t <= e and f >= s
    )
    assert pairs == expected


def test_islands(spark):
    day = 86_400_000_000
    rows = [(1, 0, 10), (1, 5, 20), (1, 20, 30), (1, 40, 3 * day), (1, 2 * day, 2 * day + 5),
            (1, 3 * day, 3 * day + 1), (2, 7, 9)]
    df = spark.createDataFrame(rows, "k bigint, lo bigint, hi bigint")
    found = {(r.k, r.lo): r.island for r in label_islands(df, "k", "lo", "hi").collect()}
    assert found == {
        (1, 0): 0, (1, 5): 0, (1, 20): 20, (1, 40): 40, (1, 2 * day): 40,
        (1, 3 * day): 3 * day, (2, 7): 7,
    }


def test_islands_of_one_hot_day(spark):
    """One key whose spans all start on one day, many of them at one instant, over several ranges."""
    rnd = random.Random(4)
    spans = set()
    for _ in range(3000):
        low = rnd.choice([0, 500, rnd.randrange(200_000), rnd.randrange(200_000)])
        spans.add((1, low, low + rnd.choice([1, 3, 40, 300])))
    spans |= {(2, 5, 9), (2, 9, 10)}
    df = spark.createDataFrame(sorted(spans), "k int, lo long, hi long").repartition(3)
    found = {(r.k, r.lo, r.hi): r.island for r in label_islands(df, "k", "lo", "hi").collect()}
    label, reach, key = None, None, None
    for k, lo, hi in sorted(spans):
        if k != key or lo >= reach:
            key, label, reach = k, lo, hi
        reach = max(reach, hi)
        assert found[k, lo, hi] == label
    assert len(found) == len(spans)


def test_long_conflict_lists_are_paged(spark):
    """One request that meets more than fits on a page: nothing is lost, no row holds more."""
    wish = [(1, 1, at(0), at(0), 600), (2, 1, at(0), at(2), 30), (3, 2, at(0), at(0), 60)]
    appts = [(i, 1, f"t{i}", at(1), at(4), "confirmed") for i in range(95)] + [(500, 1, "early", at(0), at(1), "confirmed")]
    requests, appointments = spark.createDataFrame(wish, REQUEST), spark.createDataFrame(appts, APPOINTMENT)
    pages = av.conflict_pages(av.conflict_pairs(requests, appointments), 20).collect()
    found = {}
    for row in sorted(pages, key=lambda r: (r.request_id, r.page)):
        assert len(row.conflicts) <= 20
        found.setdefault(row.request_id, []).extend(c.id for c in row.conflicts)
    assert found == {1: [*range(95), 500], 2: list(range(95))}
    assert sorted((r.request_id, r.page) for r in pages) == [(i, p) for i in (1, 2) for p in range(1, 6)]
    for page, kept in ((20, 20), (95, 95), (1000, 96)):
        rows = {r.request_id: r for r in av.check_availability(requests, appointments, page=page).collect()}
        assert [(rows[i].n_conflicts, len(rows[i].conflicts)) for i in (1, 2, 3)] == [(96, kept), (95, min(kept, 95)), (0, 0)]
        assert [c.id for c in rows[2].conflicts] == list(range(min(kept, 95))) and rows[3].available


def test_busy_times_of_a_hot_day(spark):
    """One calendar whose appointments all start on one day, a long one first, over several ranges."""
    rnd = random.Random(8)
    appts = [(0, 0, "all day", at(0), at(9), "confirmed")]
    for i in range(1, 700):
        start = at(0) + timedelta(seconds=rnd.randrange(86_000))
        appts.append((i, 0, f"t{i}", start, start + timedelta(seconds=rnd.choice([0, -40, 5, 60, 900])), "confirmed"))
    wish = [(i, 0, at(0), at(0) + timedelta(seconds=rnd.randrange(90_000)), rnd.choice([-5, 0, 1, 30])) for i in range(150)]
    want = brute(wish, appts)
    answered = av.availability(spark.createDataFrame(wish, REQUEST), spark.createDataFrame(appts, APPOINTMENT).repartition(4))
    for row in answered.collect():
        assert (row.available, [(c.id, c.title) for c in row.conflicts], row.suggested_times) == want[row.request_id]
    busy = av.busy_times(spark.createDataFrame(appts, APPOINTMENT))
    inside = [r for r in busy.collect() if r.kind != "exact" and r._a_start > 0 and r._a_end <= at(9).timestamp() * 1e6]
    assert len([r for r in inside if r.kind == "span"]) <= 1


def test_stored_calendar_is_joined_where_it_lies(spark, tmp_path):
    """Same pairs as the plain join, and no exchange on the calendar's side of the plan."""
    rows, appts = random_calendar(11, 300, 300)
    rows += [(9_000, None, at(1), at(1), 30), (9_001, 0, at(1), None, 30), (9_002, 0, at(1), at(2), None)]
    appts += [(9_000, None, "t", at(1), at(2), "ok"), (9_001, 0, "t", None, at(2), "ok"), (9_002, 0, "t", at(1), at(2), None)]
    requests, appointments = spark.createDataFrame(rows, REQUEST), spark.createDataFrame(appts, APPOINTMENT)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        av.save_standing(appointments, "stored_calendar", 8, str(tmp_path / "calendar"))
        pairs = av.stored_conflict_pairs(requests, "stored_calendar")
        plan = pairs._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        )
        assert "hashpartitioning(_r_cal" in plan and "hashpartitioning(_a_cal" not in plan
        assert "Bucketed: true" in plan
        got = sorted(map(tuple, pairs.collect()))
        assert got == sorted(map(tuple, av.conflict_pairs(requests, appointments).collect())) and got
        none = spark.createDataFrame([], APPOINTMENT)
        av.save_standing(none, "stored_calendar", 8, str(tmp_path / "calendar"))
        assert av.stored_conflict_pairs(requests, "stored_calendar").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS stored_calendar")
