"""Tables, landed files, tasks and images."""

from __future__ import annotations

import json
import random
from datetime import timedelta

from conftest import at
from pyspark.sql import functions as F

from deskmill import schemas
from deskmill.operators import inference, tasks
from deskmill.operators.ids import ordinal
from deskmill.sources import calls, media, tables


def test_tables_are_created_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS desk")
    spark.sql("USE desk")
    try:
        tables.ensure_calendar_tables(spark)
        spark.sql("INSERT INTO availability_windows VALUES (1, 6, '10:00', '12:00', 5)")
        tables.ensure_calendar_tables(spark)
        assert spark.table("availability_windows").count() == 1
        assert [f.name for f in spark.table("appointments").schema] == [
            f.name for f in schemas.APPOINTMENTS
        ]
    finally:
        spark.sql("DROP DATABASE desk CASCADE")
        spark.sql("USE default")


def test_seed_only_when_empty(spark):
    empty = spark.createDataFrame([], schemas.AVAILABILITY_WINDOWS)
    seeded = tables.seed_if_empty(empty).orderBy("day_of_week").collect()
    assert [tuple(r) for r in seeded] == [(d + 1, d, "09:00", "17:00", 15) for d in range(5)]
    one = spark.createDataFrame([(1, 6, "10:00", "12:00", 5)], schemas.AVAILABILITY_WINDOWS)
    assert tables.seed_if_empty(one).count() == 1


def test_seed_per_calendar(spark):
    calendars = spark.createDataFrame([(1,), (2,)], "calendar_id bigint")
    windows = spark.createDataFrame(
        [(1, 6, "10:00", "12:00", 5)],
        "calendar_id bigint, day_of_week int, start_time string, end_time string, buffer_minutes int",
    )
    rows = tables.seed_windows(calendars, windows).collect()
    assert sorted((r.calendar_id, r.day_of_week) for r in rows) == [(1, 6)] + [(2, d) for d in range(5)]


def test_attendees_json(spark):
    df = spark.createDataFrame([(["a", "b"],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(tables.attendees_json(F.col("a"))).collect()] == ['["a","b"]', "[]"]


def test_call_turns_from_files(spark, tmp_path):
    turn = {"call_sid": "CA1", "ts": "2024-03-01T10:00:00Z", "event_id": 1, "from_number": "+1", "speech_result": ""}
    (tmp_path / "t.json").write_text(json.dumps(turn))
    row = calls.read_call_turns(spark, str(tmp_path)).first()
    assert (row.call_sid, row.ts, row.speech_result) == ("CA1", at(10), "")
    assert calls.read_call_turns(spark, str(tmp_path), streaming=True, max_files_per_trigger=1).isStreaming


def test_media_manifest(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt", "d", "with space.gif"):
        (tmp_path / name).write_bytes(b"data")
    landed = F.lit("2024-03-01 10:20:30").cast("timestamp")
    rows = {r.name: r for r in media.media_manifest(spark, str(tmp_path), landed).collect()}
    assert rows["a.png"].stored_name == "20240301_102030_a.png"
    assert {n: r.content_type for n, r in rows.items()} == {
        "a.png": "image/png", "b.JPG": "image/jpeg", "c.txt": None, "d": None, "with space.gif": "image/gif",
    }
    assert {n for n, r in rows.items() if r.reject_reason} == {"c.txt", "d"}
    assert rows["d"].reject_reason == media.NOT_AN_IMAGE


def test_images_to_task_progress(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(b"good")
    (tmp_path / "bad.png").write_bytes(b"bad")

    def load():
        def model(data, question):
            if data == b"bad":
                raise ValueError("cannot open")
            return {"Is": "completed", "De": "a wall", "Wh": "construction"}[question[:2]]

        return model

    images = media.media_manifest(spark, str(tmp_path), with_content=True)
    seen = inference.analyze_images(images, load)
    assert "content" not in seen.columns
    rows = {r.name: r for r in seen.collect()}
    good, bad = rows["good.png"], rows["bad.png"]
    assert (good.description, good.task_type, good.completion_status, good.error) == (
        "a wall", "construction", "completed", None,
    )
    assert (bad.description, bad.error) == (None, "cannot open")

    hour = F.when(F.col("name") == "good.png", 10).otherwise(9)
    analyses = seen.select(
        F.lit(1).alias("task_id"), hour.cast("bigint").alias("analysis_id"),
        F.timestamp_seconds(hour).alias("ts"), "completion_status", "error",
    )
    todo = spark.createDataFrame([(1, "wall"), (2, "roof")], "task_id bigint, title string")
    progress = {r.task_id: (r.completion_status, r.error) for r in tasks.task_progress(todo, analyses).collect()}
    assert progress == {1: ("completed", None), 2: (None, None)}


def test_links_need_a_task_id(spark):
    analyses = spark.createDataFrame(
        [(1, 5, "ok", None), (2, 0, "ok", None), (3, None, "ok", None), (4, 5, None, "broken"), (5, 9, "ok", None)],
        "analysis_id bigint, task_id bigint, completion_status string, error string",
    )
    todo = spark.createDataFrame([(5, "five")], "task_id bigint, title string")
    rows = {r.analysis_id: r.title for r in tasks.link_images(analyses, todo).collect()}
    assert rows == {1: "five", 4: "five", 5: None}


def test_create_tasks(spark):
    asked = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "n bigint, title string")
    known = spark.createDataFrame([(7,)], "task_id bigint")
    rows = {r.n: (r.task_id, r.response) for r in tasks.create_tasks(asked, known, ["n"]).collect()}
    assert rows == {1: (8, "Task created with ID 8."), 3: (9, "Task created with ID 9.")}


def test_timeline_positions_of_a_hot_task(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), at(0) + timedelta(minutes=rnd.randrange(9000)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "task_id bigint, ts timestamp, event_id bigint")
    wanted = spark.createDataFrame([(1,), (2,)], "task_id bigint")
    found = {r.event_id: r.position for r in tasks.task_timeline(df, wanted).collect()}
    for task in (1, 2):
        ordered = sorted((ts, i) for t, ts, i in rows if t == task)
        assert [found[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    assert len(found) == sum(t != 3 for t, _, _ in rows)
    assert ordinal(df, "task_id", ["ts", "event_id"], "n").count() == len(rows)


def test_run_folder_is_removed(spark):
    import os

    from deskmill.session import durable, run_folder

    with run_folder(spark) as folder:
        assert durable(spark.range(5)).count() == 5
        assert os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_hot_key_at_one_instant_is_spread(spark):
    """All rows of one key and instant: no task gets more than its share, ordinals are right."""
    from deskmill.operators.ids import in_ranges

    rows = spark.range(20_000).selectExpr("7L AS k", "timestamp'2024-01-01' AS ts", "id AS event_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is tiny
    try:
        ranged = in_ranges(rows, ["k", "ts", "event_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= 2 and max(sizes) <= 2 * 20_000 / len(sizes)
    numbered = ordinal(rows, "k", ["ts", "event_id"], "n")
    assert numbered.filter("n != event_id + 1").count() == 0 and numbered.count() == 20_000
