"""Stored tables: create, seed, read, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill import schemas

# The default working hours, Monday (0) to Friday (4).
DEFAULT_DAYS = 5
DEFAULT_HOURS = ("09:00", "17:00")
DEFAULT_BUFFER = 15


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Create a Parquet table in the catalog unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def ensure_calendar_tables(spark: SparkSession) -> None:
    ensure_table(spark, "appointments", schemas.APPOINTMENTS)
    ensure_table(spark, "availability_windows", schemas.AVAILABILITY_WINDOWS)


def _defaults(spark: SparkSession) -> DataFrame:
    start, end = DEFAULT_HOURS
    return spark.range(DEFAULT_DAYS).selectExpr(
        "id + 1 AS id",
        "cast(id AS int) AS day_of_week",
        f"'{start}' AS start_time",
        f"'{end}' AS end_time",
        f"{DEFAULT_BUFFER} AS buffer_minutes",
    )


def seed_if_empty(windows: DataFrame) -> DataFrame:
    """``windows``, or the default working hours when it has no row at all."""
    defaults = _defaults(windows.sparkSession).filter(~windows.limit(1).exists())
    return windows.unionByName(defaults)


def seed_windows(calendars: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``seed_if_empty``, for each calendar of its own.

    ``calendars`` has one row per ``calendar_id``. Stored hours are kept; only
    calendars without any get the defaults.
    """
    start, end = DEFAULT_HOURS
    missing = calendars.select("calendar_id").join(
        windows.select("calendar_id"), "calendar_id", "left_anti"
    )
    defaults = missing.selectExpr(
        "calendar_id",
        f"explode(sequence(0, {DEFAULT_DAYS - 1})) AS day_of_week",
        f"'{start}' AS start_time",
        f"'{end}' AS end_time",
        f"{DEFAULT_BUFFER} AS buffer_minutes",
    )
    return windows.unionByName(defaults)


def load_appointments(spark: SparkSession, path: str) -> DataFrame:
    """The stored calendar, by declared schema (no inference pass over the files)."""
    return spark.read.schema(schemas.APPOINTMENTS).parquet(path)


def append_bookings(rows: DataFrame, path: str) -> None:
    """Append appointment rows (see ``booking.appointment_rows``)."""
    names = [f.name for f in schemas.APPOINTMENTS.fields]
    rows.select(*names).write.mode("append").parquet(path)


def attendees_json(attendees: Column) -> Column:
    """Attendees as JSON text, for sinks without array columns."""
    return F.to_json(F.coalesce(attendees, F.array().cast("array<string>")))
