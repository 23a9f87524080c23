"""Checks on incoming request records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.intents import with_json_object
from deskmill.functions.times import parse_iso

# Reasons given to the caller, and the default slot length.
MISSING = "Missing title or start_datetime"
BAD_DATETIME = "Invalid datetime"
BAD_DATETIME_FORMAT = "Invalid datetime format"
DEFAULT_MINUTES = 60

# Added here: the two cases end as a server error elsewhere.
BAD_BODY = "Invalid request body"
BAD_DURATION = "Invalid duration"


def validate_bookings(forms: DataFrame, payload: str = "payload") -> DataFrame:
    """Read a JSON booking form; ``reject_reason`` is NULL for good ones.

    Tests the presence of the keys, so an empty title passes. Filter on
    ``reject_reason`` for the two outputs.
    """
    fields = F.col("_form")
    return (
        with_json_object(forms, F.trim(F.col(payload)), "_form")
        .withColumn("start", parse_iso(F.try_element_at(fields, F.lit("start_datetime"))))
        .withColumns(
            {
                "title": F.try_element_at(fields, F.lit("title")),
                "duration_minutes": F.expr(
                    f"""CASE WHEN map_contains_key(_form, 'duration')
                        THEN try_cast(_form['duration'] AS decimal(18,6))
                        WHEN _form IS NOT NULL THEN cast({DEFAULT_MINUTES} AS decimal(18,6)) END"""
                ),
                "attendees": F.expr(
                    """coalesce(from_json(_form['attendees'], 'array<string>'),
                        cast(array() AS array<string>))"""
                ),
                "reject_reason": F.expr(
                    f"""CASE WHEN _form IS NULL THEN '{BAD_BODY}'
                        WHEN NOT map_contains_key(_form, 'title')
                          OR NOT map_contains_key(_form, 'start_datetime') THEN '{MISSING}'
                        WHEN start IS NULL THEN '{BAD_DATETIME}'
                        WHEN map_contains_key(_form, 'duration')
                          AND try_cast(_form['duration'] AS decimal(18,6)) IS NULL
                          THEN '{BAD_DURATION}' END"""
                ),
            }
        )
        .drop("_form")
    )


def validate_availability(
    queries: DataFrame, datetime_col: str = "datetime_str", duration_col: str = "duration"
) -> DataFrame:
    """Read an availability query; ``reject_reason`` is NULL for good ones."""
    return queries.withColumn("start", parse_iso(F.col(datetime_col))).withColumns(
        {
            "duration_minutes": F.when(F.col(duration_col).isNull(), DEFAULT_MINUTES).otherwise(
                F.col(duration_col).try_cast("int")
            ),
            "reject_reason": F.when(F.col("start").isNull(), BAD_DATETIME_FORMAT).when(
                F.col(duration_col).isNotNull() & F.col(duration_col).try_cast("int").isNull(), BAD_DURATION
            ),
        }
    )
