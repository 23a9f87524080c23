"""Streams against the batch jobs, over several micro-batches and restarts."""

from __future__ import annotations

from datetime import timedelta

from conftest import at
from pyspark.sql import functions as F

from deskmill.functions.pii import mask_pii
from deskmill.operators.booking import book
from deskmill.operators.sessions import with_context
from deskmill.plans import views
from deskmill.schemas import CALL_TURNS
from deskmill.streaming.bookings import LONG_DAY, asked_days, booking_sink, near_bookings, stream_bookings
from deskmill.streaming.calls import answer_calls, stream_calls
from deskmill.streaming.masking import stream_pii_mask
from deskmill.streaming.runner import run_available
from deskmill.streaming.sessions import stream_sessions


def in_time_order(df, parts, path, ts):
    """Write ``df`` as files that arrive one after the other, in time order."""
    bounds = df.approxQuantile(ts + "_s", [i / parts for i in range(1, parts)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for i in range(parts):
        part = df.filter((F.col(ts + "_s") > edges[i]) & (F.col(ts + "_s") <= edges[i + 1]))
        part.drop(ts + "_s").coalesce(1).write.mode("append").parquet(f"{path}/part={i}")


def stream_of(spark, path, schema):
    # files are taken by modification time, one per micro-batch
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def seconds(df, ts):
    return df.withColumn(ts + "_s", F.unix_micros(ts).cast("double"))


def same(left, right):
    columns = sorted(left.columns)
    return sorted(map(str, left.select(columns).collect())) == sorted(
        map(str, right.select(columns).collect())
    )


def turns(ev):
    return ev.selectExpr(
        "event_id", "cast(user_id AS string) AS session_id", "ts", "event_type AS intent",
        "concat('r', event_id) AS response",
    ).withColumn("session_id", F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE session_id END"))


def test_sessions_over_micro_batches(spark, sf_dir, tmp_path):
    batch = turns(views.events(spark, sf_dir))
    in_time_order(seconds(batch, "ts"), 3, str(tmp_path / "in"), "ts")
    source = stream_of(spark, str(tmp_path / "in"), batch.schema)
    assert same(run_available(stream_sessions(source), "s"), with_context(batch))


def test_sessions_resume_from_their_checkpoint(spark, tmp_path):
    schema = "event_id bigint, session_id string, ts timestamp, intent string, response string"
    where = {"checkpoint": str(tmp_path / "c"), "out": str(tmp_path / "o")}

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return run_available(stream_sessions(source), "s", **where).orderBy("event_id").collect()

    run([(1, "a", at(8), "i1", "r1")])
    rows = run([(2, "a", at(9), "i2", "r2"), (3, "b", at(9), "i3", "r3")])
    assert [(r.event_id, r.prev_intent) for r in rows] == [(1, None), (2, "i1"), (3, None)]
    assert len(run([])) == 3


def test_sessions_expire_only_with_a_ttl(spark, tmp_path):
    schema = "event_id bigint, session_id string, ts timestamp, intent string, response string"
    files = [
        [(1, "a", at(8), "i1", "r1")],
        [(2, "b", at(20), "i2", "r2")],
        [(3, "b", at(21), "i3", "r3")],
        [(4, "a", at(22), "i4", "r4")],
    ]
    # each run is a restart: the watermark of the runs before is kept with the state
    for ttl, expected in [(None, "i1"), (timedelta(hours=2), None)]:
        base = tmp_path / str(ttl)
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(base / "in"))
            source = spark.readStream.schema(schema).parquet(str(base / "in")).withWatermark("ts", "1 minute")
            out = run_available(
                stream_sessions(source, ttl=ttl), "s", str(base / "c"), str(base / "o")
            )
        found = {r.event_id: r.prev_intent for r in out.collect()}
        assert found[4] == expected and found[3] == "i2"


def test_calls(spark, sf_dir, tmp_path):
    batch = views.call_turns(views.events(spark, sf_dir))
    in_time_order(seconds(batch, "ts"), 2, str(tmp_path / "in"), "ts")
    source = stream_of(spark, str(tmp_path / "in"), CALL_TURNS)
    assert same(run_available(stream_calls(source), "c"), answer_calls(batch))


def test_silent_turns_leave_the_context_alone(spark):
    rows = [("c", at(8), 1, "", "book it"), ("c", at(9), 2, "", None), ("c", at(10), 3, "", "a free day")]
    found = {r.event_id: r for r in answer_calls(spark.createDataFrame(rows, CALL_TURNS)).collect()}
    assert found[2].intent is None and found[3].prev_intent == "book_appointment"


def test_masking(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream_of(spark, str(tmp_path / "in"), docs.schema)
    streamed = run_available(stream_pii_mask(source, "text").select("doc_id", "masked"), "m")
    assert same(streamed, mask_pii(docs, "text").select("doc_id", "masked"))


def test_bookings_over_micro_batches_and_replay(spark, sf_dir, tmp_path):
    ev = views.events(spark, sf_dir)
    batch, standing = views.requests(ev), views.appointments(ev)
    in_time_order(seconds(batch, "arrival"), 3, str(tmp_path / "in"), "arrival")
    source = stream_of(spark, str(tmp_path / "in"), batch.schema)
    paths = [str(tmp_path / name) for name in ("booked", "outcomes", "checkpoint")]
    expected = book(batch, standing).drop("conflicts")
    streamed = stream_bookings(source, standing, *paths).drop("conflicts")
    assert same(streamed, expected)
    # nothing new: a restart adds nothing
    assert stream_bookings(source, standing, *paths).count() == batch.count()
    # a lost commit: the last micro-batch is taken again, into the same folder
    last = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert same(stream_bookings(source, standing, *paths).drop("conflicts"), expected)
    booked = spark.read.parquet(paths[0])
    assert booked.count() == booked.select("id").distinct().count() == expected.filter("success").count()


def test_a_late_batch_reads_its_days_only(spark, tmp_path):
    """Bookings of other days stay closed, long ones and those that reach in over midnight do not."""
    kind = "request_id bigint, calendar_id bigint, arrival timestamp, title string, start timestamp, duration_minutes int"
    none = spark.createDataFrame([], "id bigint, calendar_id bigint, title string, start timestamp, end timestamp, status string")
    booked, done = str(tmp_path / "booked"), str(tmp_path / "done")
    take = booking_sink(spark, none, booked, done)
    wishes = [(i, i % 5, at(8), "x", at(9, day=1) + timedelta(days=i), 30) for i in range(20)]
    wishes += [(50, 1, at(8), "long", at(0, day=1) + timedelta(days=40), 60 * 24 * 40), (51, 2, at(8), "night", at(23, day=3), 120)]
    take(spark.createDataFrame(wishes, kind), 0)
    late = [
        (100, 2, at(9), "meets the night", at(0, 30, day=4), 15),
        (101, 1, at(9), "meets the long one", at(0, day=1) + timedelta(days=70), 15),
        (102, 1, at(9), "free", at(12, day=4), 15),
    ]
    late = spark.createDataFrame(late, kind)
    files = near_bookings(spark, booked, asked_days(late, 2 * 3_600_000_000), 1).inputFiles()
    # the days of the wishes, the day before each, and the folder of long bookings
    days = {f.split("/day=")[1].split("/")[0] for f in files}
    assert days == {str(LONG_DAY), "19785", "19786"}
    take(late, 1)
    outcome = {r.request_id: r for r in spark.read.parquet(f"{done}/batch=1").collect()}
    assert [outcome[i].success for i in (100, 101, 102)] == [False, False, True]
    assert outcome[102].appointment_id == 23
    assert [c.title for c in outcome[100].conflicts] == ["night"]
    take(late, 1)  # a replay
    assert spark.read.parquet(booked).count() == 23


def test_calls_read_the_source_once(spark, tmp_path):
    schema = CALL_TURNS
    rows = [("c", at(8), 1, "", "book it"), ("c", at(9), 2, "", None), ("c", at(10), 3, "", "a free day"), (None, at(10), 4, "", "a todo")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    streamed = stream_calls(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    plan = streamed._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1
    found = {r.event_id: r for r in run_available(streamed, "c").collect()}
    assert found[2].intent is None and found[2].prev_intent is None and found[2].reply.startswith("I didn't catch")
    assert found[3].prev_intent == "book_appointment" and found[4].prev_intent is None
