"""Tasks: creation, progress from images, timelines.

Only the calls of a task store are known, not its inside. Known: a title is
required, description and due date are optional, an id comes back; progress takes a
task id and an analysis; a timeline is a list for one task id. Chosen here: running
ids, the latest analysis decides the status, timelines by time and event id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.operators.dispatch import TASK_CREATED
from deskmill.operators.ids import assign_ids, ordinal


def create_tasks(requests: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """New tasks with ``task_id`` and the ``response``, for requests with a title."""
    new = assign_ids(requests.filter("title IS NOT NULL"), existing, order, "task_id")
    before, after = TASK_CREATED.split("{}")
    return new.withColumn(
        "response", F.concat(F.lit(before), F.col("task_id").cast("string"), F.lit(after))
    )


def link_images(analyses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Analyses with the task they belong to; id 0 and NULL belong to none.

    Failed analyses link too, with their ``error``. An unknown task leaves the
    task columns NULL.
    """
    return analyses.filter("task_id IS NOT NULL AND task_id != 0").join(tasks, "task_id", "left")


def task_progress(tasks: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each task with ``completion_status`` and ``error`` of its latest analysis.

    The latest row per task is found before the join, with a partial aggregate, so
    a task with very many images costs no more than another.
    """
    latest = (
        analyses.filter("task_id IS NOT NULL AND task_id != 0")
        .groupBy("task_id")
        .agg(
            F.expr(
                "max_by(struct(ts, analysis_id, completion_status, error), struct(ts, analysis_id))"
            ).alias("_latest")
        )
        .select("task_id", "_latest.completion_status", "_latest.error", F.col("_latest.ts").alias("updated_at"))
    )
    return tasks.join(latest, "task_id", "left")


def task_timeline(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of the given tasks with their position, by time then event id."""
    wanted = events.join(ids.select("task_id"), "task_id", "left_semi")
    return ordinal(wanted, "task_id", ["ts", "event_id"], "position")
