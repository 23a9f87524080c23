"""Declared schemas of the stored tables and landed records."""

from __future__ import annotations

from pyspark.sql import types as T

APPOINTMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("calendar_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("attendees", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("call_log_id", T.LongType()),
        T.StructField("created_by", T.StringType()),
    ]
)

AVAILABILITY_WINDOWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("buffer_minutes", T.IntegerType()),
    ]
)

CALL_TURNS = T.StructType(
    [
        T.StructField("call_sid", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("from_number", T.StringType()),
        T.StructField("speech_result", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
