"""Bookings taken from a stream of requests into the calendar table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.times import DAY_US
from deskmill.operators.availability import wished_span
from deskmill.operators.booking import accept, appointment_rows, outcomes
from deskmill.operators.intervals import LONG_US
from deskmill.schemas import APPOINTMENTS
from deskmill.session import durable, fresh_dir

# Booked rows lie in one folder per day of their start and bucket of calendars; those
# longer than 32 days lie in a folder of their own, which every batch reads.
BUCKETS = 4
LONG_DAY = -10_000_000

_FOLDERS = ("day", "bucket", "batch")
_STORED = T.StructType([*APPOINTMENTS.fields, *(T.StructField(n, T.LongType()) for n in _FOLDERS)])
_STATE = "highest bigint, longest bigint"

_BUCKET = f"pmod(xxhash64(calendar_id), {BUCKETS}L)"


def _day(micros: str) -> str:
    return f"(({micros} - pmod({micros}, {DAY_US}L)) div {DAY_US}L)"


def _low_high(start: str, end: str) -> list[str]:
    return [f"least({start}, {end}) AS _low", f"greatest({start}, {end}) AS _high"]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, with one listing and no look inside them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


@dataclass(frozen=True)
class Asked:
    """What the slots of a micro-batch can meet: days of start, buckets, and instants."""

    days: frozenset[int]
    run: tuple[int, int] | None  # for slots of over 32 days: all days between
    buckets: tuple[int, ...]
    low: datetime | None
    high: datetime | None

    def meets(self, day: int) -> bool:
        return day == LONG_DAY or day in self.days or (self.run is not None and self.run[0] <= day <= self.run[1])


def asked_days(requests: DataFrame, longest: int) -> Asked:
    """One look at a micro-batch.

    ``longest`` is the length of the longest booking outside the folder of long ones: so much
    earlier a booking may start and still reach into a slot. Slots of ordinary length give
    single days, at most as many as the calendar has.
    """
    spans = requests.selectExpr("calendar_id", "start", *wished_span(requests))
    spans = spans.filter("_start IS NOT NULL AND _end IS NOT NULL").selectExpr("calendar_id", *_low_high("_start", "_end"))
    days = spans.selectExpr(
        f"{_BUCKET} AS bucket", "_low", "_high", f"_high - _low > {LONG_US}L AS wide",
        f"{_day(f'(_low - {longest}L)')} AS first", f"{_day('_high')} AS last",
    ).selectExpr("*", "explode(CASE WHEN wide THEN array(first) ELSE sequence(first, last) END) AS day")
    row = days.agg(
        F.expr("collect_set(day) AS days"),
        F.expr("min(CASE WHEN wide THEN first END) AS first"),
        F.expr("max(CASE WHEN wide THEN last END) AS last"),
        F.expr("collect_set(bucket) AS buckets"),
        F.expr("timestamp_micros(min(_low)) AS low"),
        F.expr("timestamp_micros(max(_high)) AS high"),
    ).first()
    run = None if row.first is None else (row["first"], row["last"])
    return Asked(frozenset(row.days), run, tuple(row.buckets), row.low, row.high)


def near_bookings(spark: SparkSession, booked_path: str, asked: Asked, batch: int) -> DataFrame:
    """Bookings of earlier micro-batches that can reach into the slots asked about.

    Only the folders of the days asked about are opened, and in them only the buckets of
    the calendars asked about, so what a batch reads does not grow with the history.
    """
    days = [n for n in _folders(spark, booked_path) if n.startswith("day=") and asked.meets(int(n[4:]))]
    if not days:
        return spark.createDataFrame([], _STORED)
    opened = [f"{booked_path}/{name}" for name in days]
    stored = spark.read.schema(_STORED).option("basePath", booked_path).parquet(*opened)
    return stored.filter((F.col("batch") < batch) & F.col("bucket").isin(*asked.buckets))


def _near(appointments: DataFrame, asked: Asked) -> DataFrame:
    """Appointments that reach into the time the requests ask about."""
    if asked.low is None:
        return appointments.filter(F.lit(False))
    return appointments.filter(
        ((F.col("start") <= asked.high) | (F.col("end") <= asked.high))
        & ((F.col("start") >= asked.low) | (F.col("end") >= asked.low))
    )


def _state(spark: SparkSession, path: str, batch: int) -> tuple[int, int]:
    """Highest id and longest booking after the micro-batch before ``batch``."""
    row = None
    names = _folders(spark, path)
    known = [int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) < batch]
    if known:
        row = spark.read.schema(_STATE).parquet(f"{path}/batch={max(known)}").first()
    return (row.highest, row.longest) if row else (0, 0)


def booking_sink(
    spark: SparkSession, standing: DataFrame, booked_path: str, outcomes_path: str, state_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that books one micro-batch after the other.

    The calendar is ``standing`` plus what earlier micro-batches wrote under
    ``booked_path``, by day and bucket of calendars: the table itself is the state, so
    nothing is kept per calendar in memory and a busy calendar is spread as in a batch job.
    A micro-batch opens the folders it asks about. The highest id and the length of the
    longest booking are one row per micro-batch under ``state_path`` (by default beside the
    bookings). Each micro-batch owns its folders and overwrites them, so a replay after a
    failure leaves no duplicates.
    """
    state_path = state_path or f"{booked_path.rstrip('/')}-state"
    spark.createDataFrame([], APPOINTMENTS).write.mode("overwrite").parquet(
        f"{booked_path}/day={LONG_DAY}/bucket=0/batch=-1"
    )
    # the standing table is no history of the stream: one look per start
    highest_standing = standing.agg(F.max("id")).first()[0] or 0

    def take(requests: DataFrame, batch: int) -> None:
        # also read by the passes that look for days, so not from the source twice
        requests = durable(requests)
        highest, longest = _state(spark, state_path, batch)
        highest = max(highest, highest_standing)
        asked = asked_days(requests, longest)
        columns = ["id", "calendar_id", "title", "start", "end", "status"]
        calendar = standing.select(*columns)
        if batch:
            calendar = calendar.unionByName(near_bookings(spark, booked_path, asked, batch).select(*columns))
        near = _near(calendar, asked)
        known = spark.range(1).select(F.lit(highest).cast("bigint").alias("id"))
        accepted = accept(requests, near, existing_ids=known)
        outcomes(requests, near, accepted).write.mode("overwrite").parquet(f"{outcomes_path}/batch={batch}")

        spans = _low_high("unix_micros(start)", "unix_micros(end)")
        rows = appointment_rows(accepted).selectExpr("*", *spans).selectExpr(
            *(f"`{f.name}`" for f in APPOINTMENTS.fields),
            f"CASE WHEN _high - _low > {LONG_US}L THEN {LONG_DAY}L ELSE {_day('_low')} END AS day",
            f"{_BUCKET} AS bucket",
            f"{batch}L AS batch",
            "_high - _low AS _length",
        )
        seen = Observation()
        ordinary = F.max(F.expr(f"CASE WHEN day <> {LONG_DAY}L THEN _length END"))
        (
            rows.observe(seen, F.max("id").alias("id"), ordinary.alias("length"))
            .drop("_length")
            .hint("rebalance", "day", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_FOLDERS)
            .parquet(booked_path)
        )
        state = [(max(highest, seen.get["id"] or 0), max(longest, seen.get["length"] or 0))]
        spark.createDataFrame(state, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch={batch}")

    return take


def stream_bookings(
    requests: DataFrame,
    standing: DataFrame,
    booked_path: str | None = None,
    outcomes_path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Book everything present in the stream; the outcomes as a table."""
    spark = requests.sparkSession
    booked_path = booked_path or fresh_dir(spark, "booked")
    outcomes_path = outcomes_path or fresh_dir(spark, "outcomes")
    query = (
        requests.writeStream.foreachBatch(
            booking_sink(spark, standing, booked_path, outcomes_path)
        )
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "bookings-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(outcomes_path).drop("batch")
