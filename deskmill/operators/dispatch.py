"""From intents to replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.times import booking_message, iso, parse_iso
from deskmill.operators.availability import suggest_slots, wished_span
from deskmill.operators.booking import NOT_AVAILABLE, accept, as_booked
from deskmill.session import durable

# The replies.
NEED_DATETIME = "I need a date and time to check availability."
NEED_DETAILS = "I didn't get all the details. Please provide more information."
NOT_SURE = "I'm not sure how to help with that. Can you rephrase?"
FAILED = "Sorry, I encountered an error processing your request."
IS_AVAILABLE = "Yes, {} is available. Would you like to book it?"
HOW_ABOUT = "That time is not available. How about {}?"
NO_AVAILABILITY = "Sorry, no availability around that time."
TASK_CREATED = "Task created with ID {}."

DEFAULT_TITLE = "Appointment"
DEFAULT_MINUTES = 60


def _text(value: str) -> str:
    return '"' + value + '"'


def _around(template: str, value: str) -> str:
    before, after = template.split("{}")
    return f"concat({_text(before)}, {value}, {_text(after)})"


def dispatch(df: DataFrame) -> DataFrame:
    """Add ``action`` (check, book, task) or, where none is possible, the ``response``.

    Needs ``intent`` and ``entities`` (NULL for rule intents). Checking wants a
    non-empty datetime, booking and tasks want their key to be there.
    """

    def lacks(name: str) -> str:
        return f"NOT coalesce(map_contains_key(entities, '{name}'), false)"

    no_datetime = "coalesce(entities['datetime'], '') = ''"
    return df.withColumns(
        {
            "action": F.expr(
                f"""CASE
                WHEN intent = 'check_availability' AND NOT ({no_datetime}) THEN 'check'
                WHEN intent = 'book_appointment' AND NOT ({lacks('datetime')}) THEN 'book'
                WHEN intent = 'create_task' AND NOT ({lacks('title')}) THEN 'task' END"""
            ),
            "response": F.expr(
                f"""CASE
                WHEN intent = 'check_availability' THEN
                    CASE WHEN {no_datetime} THEN {_text(NEED_DATETIME)} END
                WHEN intent = 'book_appointment' THEN
                    CASE WHEN {lacks('datetime')} THEN {_text(NEED_DETAILS)} END
                WHEN intent = 'create_task' THEN
                    CASE WHEN {lacks('title')} THEN {_text(NEED_DETAILS)} END
                ELSE {_text(NOT_SURE)} END"""
            ),
        }
    )


def calendar_calls(df: DataFrame, accept_duration_minutes: bool = False) -> DataFrame:
    """Dispatched rows that ask the calendar, in request form.

    ``duration`` is read, 60 where it is missing. The key that prompts ask for,
    ``duration_minutes``, is ignored unless ``accept_duration_minutes``. Where time
    or length cannot be read, or the end lies outside the calendar, ``start`` is NULL.
    """
    duration = f"""CASE WHEN map_contains_key(entities, 'duration')
        THEN try_cast(entities['duration'] AS decimal(18,6)) ELSE {DEFAULT_MINUTES} END"""
    if accept_duration_minutes:
        duration = f"""CASE WHEN NOT map_contains_key(entities, 'duration')
            AND map_contains_key(entities, 'duration_minutes')
            THEN try_cast(entities['duration_minutes'] AS decimal(18,6)) ELSE {duration} END"""
    asked = df.filter("action IN ('check', 'book')").withColumn("duration_minutes", F.expr(duration))
    start = parse_iso(F.expr("entities['datetime']"))
    asked = asked.withColumn("start", F.when(F.col("duration_minutes").isNotNull(), start))
    end = wished_span(asked)[1].removesuffix(" AS _end")
    return asked.withColumns(
        {
            "start": F.when(F.expr(end).isNotNull(), F.col("start")),
            "title": F.expr(
                f"""CASE WHEN map_contains_key(entities, 'title') THEN entities['title']
                    ELSE '{DEFAULT_TITLE}' END"""
            ),
        }
    )


def dispatch_calendar(df: DataFrame, appointments: DataFrame) -> DataFrame:
    """Replies of check and book rows: ``request_id, action, response``.

    Needs ``request_id, calendar_id, arrival, action, entities``. Rows count as
    served in arrival order: a check sees the bookings accepted before it.
    """
    # Read by several branches below, each with its own filter: without a table
    # between, the replies would be parsed again inside every filter.
    served = durable(df.select("request_id", "calendar_id", "arrival", "action", "entities"))
    calls = durable(
        calendar_calls(served)
        .withColumn("_asked", F.expr("entities['datetime']"))
        .drop("entities")
    )
    usable = calls.filter("start IS NOT NULL")
    wanted = "request_id", "calendar_id", "arrival", "start", "duration_minutes", "title"
    bookings = usable.filter("action = 'book'").select(*wanted)
    checks = usable.filter("action = 'check'").select(*wanted)
    accepted = accept(bookings, appointments)
    booked = bookings.join(
        accepted.select("request_id", "appointment_id"), "request_id", "left"
    ).select(
        "request_id",
        F.when(F.col("appointment_id").isNull(), NOT_AVAILABLE)
        .otherwise(booking_message(F.col("start")))
        .alias("_said"),
    )
    # A suggestion is looked for where a conflict stands, and only there: no pairs are needed.
    checked = suggest_slots(checks, appointments, 1, as_booked(accepted)).select(
        "request_id",
        F.lit(True).alias("_taken"),
        iso(F.get("suggested_times", F.lit(0))).alias("_suggested"),
    )
    return (
        calls.join(booked, "request_id", "left")
        .join(checked, "request_id", "left")
        .select(
            "request_id",
            "action",
            F.expr(
                f"""CASE WHEN start IS NULL THEN {_text(FAILED)}
                WHEN action = 'book' THEN _said
                WHEN _taken IS NULL THEN {_around(IS_AVAILABLE, "_asked")}
                WHEN _suggested IS NOT NULL THEN {_around(HOW_ABOUT, "_suggested")}
                ELSE {_text(NO_AVAILABILITY)} END"""
            ).alias("response"),
        )
    )

