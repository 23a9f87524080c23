"""Calendar conflicts, free slots and availability answers.

Requests: ``request_id, calendar_id, arrival, start, duration_minutes``.
Appointments: ``id, calendar_id, title, start, end, status``. Bookings made while
a batch is worked through may be passed as ``booked`` (appointment columns plus
``since_ts, since_id``): only requests that arrive later see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.times import DAY_US, FIRST_US, HOUR_US, LAST_US
from deskmill.operators.ids import in_ranges, ordinal
from deskmill.operators.intervals import longest, overlap_join, stored_cells
from deskmill.session import durable

# Suggestions are whole hours after the wish, before seven days.
LAST_HOUR = 7 * 24 - 1
SUGGESTIONS = 3
# Conflicts that one row lists at most; further ones go to further pages.
PAGE = 10_000

_WORDS = -(-LAST_HOUR // 64)

NO_CONFLICTS = "cast(array() AS array<struct<id:bigint,title:string>>)"
_NO_TIMES = "cast(array() AS array<timestamp>)"

# Standing rows are always seen, new bookings only by later arrivals.
_VISIBLE = """(since_ts IS NULL OR since_ts < arrival
    OR (since_ts = arrival AND since_id < request_id))"""

# Which busy times count for a request; see busy_times.
_APPLIES = """(kind = 'exact' OR (_end >= _start AND kind = 'block')
    OR (_end < _start AND kind = 'span'))"""


def conflicts(start: str, end: str, other_start: str, other_end: str) -> str:
    """SQL condition: does an appointment conflict with the wished slot?

    The second arm only matters for appointments of no or negative length: at the
    very edge of the slot they conflict here, yet leave a suggested slot free.
    """
    return f"""(({other_start} < {end} AND {other_end} > {start})
        OR ({other_start} >= {start} AND {other_end} <= {end}))"""


_CONFLICTS = conflicts("_start", "_end", "_a_start", "_a_end")


def not_cancelled(appointments: DataFrame) -> DataFrame:
    """Rows that take up time; a NULL status does not pass."""
    return appointments.filter("status != 'cancelled'")


def wished_span(requests: DataFrame) -> tuple[str, str]:
    """SQL for start and end of the wished slot in micros, as ``_start`` and ``_end``.

    An end outside the calendar (years 1 to 9999) is NULL; such a wish meets nothing.
    """
    kind = requests.schema["duration_minutes"].dataType
    exact = "decimal(19,0)" if isinstance(kind, T.IntegralType) else "decimal(18,6)"
    length = f"cast(duration_minutes AS {exact}) * 60000000"
    end = f"try_cast(unix_micros(start) + {length} AS bigint)"
    return (
        "unix_micros(start) AS _start",
        f"CASE WHEN {end} BETWEEN {FIRST_US}L AND {LAST_US}L THEN {end} END AS _end",
    )


def _wishes(requests: DataFrame) -> DataFrame:
    """Request columns under the names used in the joins, times in micros."""
    return requests.selectExpr(
        "request_id", "calendar_id AS _r_cal", "arrival", *wished_span(requests)
    )


def _standing(appointments: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    """Active appointments, then new bookings, with their validity."""
    columns = ["id", "title", "calendar_id", "start", "end"]
    rows = not_cancelled(appointments).selectExpr(
        *columns, "cast(NULL AS timestamp) AS since_ts", "cast(NULL AS bigint) AS since_id"
    )
    if booked is not None:
        rows = rows.unionByName(booked.select(*columns, "since_ts", "since_id"))
    return rows.selectExpr(
        "id",
        "title",
        "calendar_id AS _a_cal",
        "unix_micros(start) AS _a_start",
        "unix_micros(end) AS _a_end",
        "since_ts",
        "since_id",
    )


def conflict_pairs(
    requests: DataFrame, appointments: DataFrame, booked: DataFrame | None = None
) -> DataFrame:
    """``request_id, id, title`` for every request and appointment in conflict."""
    return _pairs(requests, _standing(appointments, booked))


def _pairs(requests: DataFrame, standing: DataFrame, stored: bool = False) -> DataFrame:
    pairs = overlap_join(
        _wishes(requests),
        standing,
        ("_r_cal", "_a_cal"),
        ("_start", "_end"),
        ("_a_start", "_a_end"),
        f"{_CONFLICTS} AND {_VISIBLE}",
        stored=stored,
    )
    return pairs.select("request_id", "id", "title")


def save_standing(appointments: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Write the active appointments as table ``name``, once per time cell they reach,
    bucketed and sorted by calendar and cell.

    Many batches of requests can then be joined with a calendar that is never shuffled
    again. Rows are spread over the buckets first, so each bucket is one file. A calendar's
    days lie in different buckets; a single day of one calendar is one bucket's, and
    adaptive skew splitting, which needs a shuffle on both sides, does not apply. For such data use
    :func:`conflict_pairs`. Give at least as many ``buckets`` as the later jobs have shuffle partitions.
    """
    span = ("_a_start", "_a_end")
    cells = stored_cells(_standing(appointments).drop("since_ts", "since_id"), span)
    writer = cells.repartition(buckets, "_a_cal", "_r_cell").write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "_a_cal", "_r_cell").sortBy("_a_cal", "_r_cell").saveAsTable(name)


def stored_conflict_pairs(requests: DataFrame, name: str) -> DataFrame:
    """As :func:`conflict_pairs`, with the calendar that :func:`save_standing` wrote; only the
    requests are shuffled."""
    standing = requests.sparkSession.table(name).selectExpr(
        "*", "cast(NULL AS timestamp) AS since_ts", "cast(NULL AS bigint) AS since_id"
    )
    return _pairs(requests, standing, stored=True)


def conflict_pages(pairs: DataFrame, page: int = PAGE) -> DataFrame:
    """All conflicts in numbered pages: ``request_id, page, conflicts``.

    Pages count from 1 and go by id; each holds ``page`` conflicts, the last one the rest. The
    place of a pair is counted per range of pairs (:func:`ordinal`), so neither a task nor a
    row ever holds all conflicts of one request.
    """
    placed = ordinal(pairs, "request_id", ["id", "title"], "_place")
    return (
        placed.withColumn("page", F.expr(f"(_place - 1) div {page}L + 1"))
        .groupBy("request_id", "page")
        .agg(F.expr("array_sort(collect_list(struct(id, title)))").alias("conflicts"))
    )


def conflict_lists(pairs: DataFrame, page: int = PAGE) -> DataFrame:
    """``request_id, conflicts array<struct<id,title>>, n_conflicts`` per request, by id.

    A list is whole where it fits on one page; otherwise it is the first page, and
    ``n_conflicts`` tells that :func:`conflict_pages` has more. The pairs are written,
    because they are counted before they are gathered.
    """
    pairs = durable(pairs)
    sizes = pairs.groupBy("request_id").agg(F.count("*").alias("n"))
    listed = F.expr("array_sort(collect_list(struct(id, title)))").alias("conflicts")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= page:
        return pairs.groupBy("request_id").agg(listed, F.count("*").alias("n_conflicts"))
    long_ = durable(sizes.filter(F.col("n") > page))
    whole = pairs.join(long_, "request_id", "left_anti").groupBy("request_id").agg(listed, F.count("*").alias("n_conflicts"))
    first = conflict_pages(pairs.join(long_, "request_id", "left_semi"), page).filter("page = 1")
    return whole.unionByName(
        first.join(long_, "request_id").select("request_id", "conflicts", F.col("n").alias("n_conflicts"))
    )


def check_availability(
    requests: DataFrame, appointments: DataFrame, booked: DataFrame | None = None, page: int = PAGE
) -> DataFrame:
    """Each request with ``available``, the ``conflicts`` that stand against it, and their
    number; beyond one page the rest is in :func:`conflict_pages`."""
    found = conflict_lists(conflict_pairs(requests, appointments, booked), page)
    return requests.join(found, "request_id", "left").withColumns(
        {
            "available": F.expr("conflicts IS NULL"),
            "conflicts": F.expr(f"coalesce(conflicts, {NO_CONFLICTS})"),
            "n_conflicts": F.coalesce("n_conflicts", F.lit(0)),
        }
    )


def busy_times(appointments: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    """What is enough to answer "is this slot taken?", far smaller than the calendar.

    Per calendar and day of the start:
    ``block``  unions of overlapping appointments; right for slots of no or
               positive length;
    ``span``   appointments not contained in another one; right for slots of
               negative length, which only conflict inside a single appointment;
    ``exact``  appointments of no or negative length, and new bookings, as they are.
    Equal starts are merged before the shuffle; what is left is cut into written ranges of
    calendar and start, so a hot day is spread over tasks. A range unites its own rows, and
    one row per calendar, day and range carries over how far the ranges before reach: what
    lies within that is dropped. A union that goes on beyond the border of a range is two
    overlapping blocks, which answer as one would.
    """
    merged = (
        _standing(appointments)
        .selectExpr("_a_cal", "_a_start", "_a_end", "CASE WHEN _a_end <= _a_start THEN _a_end END AS _odd")
        .groupBy("_a_cal", "_a_start", "_odd")
        .agg(F.max("_a_end").alias("_a_end"))
        .selectExpr(
            "*",
            f"_a_start - pmod(_a_start, {DAY_US}L) AS _day",
            "CASE WHEN _odd IS NULL THEN _a_end END AS _proper_end",
        )
    )
    ranged = in_ranges(merged, ["_a_cal", "_a_start", "_odd"])
    group = ["_a_cal", "_day", "_range"]
    part = Window.partitionBy(*group).orderBy("_a_start")
    earlier = part.rangeBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy(*group, "_block")
    ranges = Window.partitionBy("_a_cal", "_day").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reach_in = (
        ranged.groupBy(*group)
        .agg(F.max("_proper_end").alias("_reach"), F.max("_a_start").alias("_last"))
        .select(*group, F.max("_reach").over(ranges).alias("_reach_in"), F.max("_last").over(ranges).alias("_last_in"))
    )
    rows = (
        ranged.withColumn("_reached", F.max("_proper_end").over(earlier))
        .join(reach_in, group)
        # rows of one start may lie on both sides of a border: those do not contain each other here
        .withColumn("_reach_in", F.expr("CASE WHEN _last_in < _a_start THEN _reach_in END"))
        .filter("_odd IS NOT NULL OR coalesce(_a_end > greatest(_reached, _reach_in), true)")
        .withColumn("_reached", F.max("_proper_end").over(earlier))
        .selectExpr("*", "_odd IS NULL AND (_reached IS NULL OR _a_start >= _reached) AS _opens")
        .withColumn("_block", F.count(F.expr("CASE WHEN _opens THEN 1 END")).over(part))
        .withColumn("_block_end", F.max("_proper_end").over(block))
    )
    busy = rows.selectExpr(
        "_a_cal",
        "_a_start",
        """inline(CASE
            WHEN _odd IS NOT NULL THEN
                array(named_struct('kind', 'exact', '_a_end', _a_end))
            WHEN _opens THEN
                array(named_struct('kind', 'span', '_a_end', _a_end),
                      named_struct('kind', 'block', '_a_end', _block_end))
            ELSE array(named_struct('kind', 'span', '_a_end', _a_end)) END)""",
    ).selectExpr(
        "*", "cast(NULL AS timestamp) AS since_ts", "cast(NULL AS bigint) AS since_id"
    )
    if booked is not None:
        busy = busy.unionByName(
            booked.selectExpr(
                "calendar_id AS _a_cal",
                "unix_micros(start) AS _a_start",
                "unix_micros(end) AS _a_end",
                "'exact' AS kind",
                "since_ts",
                "since_id",
            )
        )
    return busy


def _longest_busy(appointments: DataFrame, booked: DataFrame | None) -> Column:
    """Bound for busy times: a block holds starts of one day, then the last length."""
    return DAY_US + longest(_standing(appointments, booked), ("_a_start", "_a_end"))


def blocked_wishes(
    wishes: DataFrame,
    appointments: DataFrame,
    booked: DataFrame | None = None,
    busy: DataFrame | None = None,
) -> DataFrame:
    """Wishes (in join form) with at least one conflict; a wish may come twice."""
    return overlap_join(
        wishes,
        busy_times(appointments, booked) if busy is None else busy,
        ("_r_cal", "_a_cal"),
        ("_start", "_end"),
        ("_a_start", "_a_end"),
        f"{_CONFLICTS} AND {_APPLIES} AND {_VISIBLE}",
        "left_semi",
        right_longest=_longest_busy(appointments, booked),
    )


def _taken_bits(word: int) -> str:
    """Bits of the blocked hours ``_first.._last`` that fall into one 64-bit word."""
    low = f"cast(greatest(_first - {1 + 64 * word}, 0) AS int)"
    high = f"cast(least(_last - {1 + 64 * word}, 63) AS int)"
    return (
        f"bit_or(CASE WHEN _first IS NULL OR {low} > {high} THEN 0L"
        f" ELSE shiftleft(-1L, {low}) & shiftrightunsigned(-1L, 63 - {high}) END) AS _taken{word}"
    )


def suggest_slots(
    requests: DataFrame,
    appointments: DataFrame,
    limit: int = SUGGESTIONS,
    booked: DataFrame | None = None,
) -> DataFrame:
    """``request_id, suggested_times``: the first free starts for conflicting requests.

    A busy time blocks one run of the 167 candidate hours, so the hours need not
    be spelled out as rows: each run becomes bits, the bits of a request are or-ed
    together (partially before the shuffle, in constant memory), and the first
    zero bits are the answer.
    """
    window = "_r_cal", "request_id", "arrival", "_start", "_end"
    busy = durable(busy_times(appointments, booked))
    wishes = blocked_wishes(_wishes(requests), appointments, booked, busy).selectExpr(
        *window,
        f"_start + {HOUR_US}L + least(_end - _start, 0L) AS _from",
        f"_start + {LAST_HOUR * HOUR_US}L + greatest(_end - _start, 0L) AS _until",
    )
    # Candidate k is blocked iff busy start < start + k h + length and busy end > start + k h.
    first = f"_a_start - _end - pmod(_a_start - _end, {HOUR_US}L)"
    last = f"_start - _a_end - pmod(_start - _a_end, {HOUR_US}L)"
    first = f"greatest(({first}) div {HOUR_US}L + 1, 1L)"
    last = f"least(-(({last}) div {HOUR_US}L) - 1, {LAST_HOUR}L)"
    hits = overlap_join(
        wishes,
        busy,
        ("_r_cal", "_a_cal"),
        ("_from", "_until"),
        ("_a_start", "_a_end"),
        f"{first} <= {last} AND {_APPLIES} AND {_VISIBLE}",
        "left",
        longest(_wishes(requests), ("_start", "_end")) + LAST_HOUR * HOUR_US,
        _longest_busy(appointments, booked),
    )
    # a wish with nothing around it comes through the left join with NULLs
    runs = hits.selectExpr(
        "request_id",
        "_start",
        f"CASE WHEN _a_start IS NOT NULL THEN {first} END AS _first",
        f"CASE WHEN _a_start IS NOT NULL THEN {last} END AS _last",
    )
    taken = runs.groupBy("request_id", "_start").agg(
        *[F.expr(_taken_bits(word)) for word in range(_WORDS)]
    )
    bit = " ".join(
        f"WHEN k <= {64 * (word + 1)} THEN getbit(_taken{word}, k - {1 + 64 * word})"
        for word in range(_WORDS)
    )
    return taken.selectExpr(
        "request_id",
        f"""transform(
            slice(filter(sequence(1, {LAST_HOUR}), k -> CASE {bit} END = 0), 1, {limit}),
            k -> timestamp_micros(_start + k * {HOUR_US}L)) AS suggested_times""",
    )


def availability(
    requests: DataFrame,
    appointments: DataFrame,
    limit: int = SUGGESTIONS,
    booked: DataFrame | None = None,
) -> DataFrame:
    """The full answer per request: ``available``, ``conflicts``, ``suggested_times``."""
    checked = check_availability(requests, appointments, booked)
    found = suggest_slots(requests, appointments, limit, booked)
    return checked.join(found, "request_id", "left").withColumn(
        "suggested_times", F.expr(f"coalesce(suggested_times, {_NO_TIMES})")
    )
