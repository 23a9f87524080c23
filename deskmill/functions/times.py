"""Time expressions: ISO text, end times, messages and integer micros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US
# The first and the last instant of the years 1 to 9999.
FIRST_US = -62_135_596_800_000_000
LAST_US = 253_402_300_799_999_999

# Extended ISO-8601 only; basic (20250301T150000) and week (2025-W09-6) forms
# are not accepted.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?\z"
)

# End of a wished slot as SQL; minutes may be fractional, zero or negative.
SLOT_END = """start + make_dt_interval(0, 0, 0,
    cast(cast(duration_minutes AS decimal(18,6)) * 60 AS decimal(18,6)))"""


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO string, NULL when it is not one."""
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def iso(ts: Column) -> Column:
    """ISO text to the second, with six decimals only where there are micros."""
    whole = F.pmod(F.unix_micros(ts), F.lit(SECOND_US)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def floor_to(micros: Column, width: int) -> Column:
    """Start of the ``width``-micros cell that holds ``micros``."""
    return micros - F.pmod(micros, F.lit(width))


def booking_message(start: Column) -> Column:
    return F.concat(F.lit("Booked for "), F.date_format(start, "MMMM dd 'at' hh:mm a"))


def naive(ts: Column) -> Column:
    """Zone-free copy of a timestamp, for results compared outside Spark."""
    return ts.cast("timestamp_ntz")
