"""Booking admission in arrival order, and the rows it appends."""

from __future__ import annotations

import bisect
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.times import SLOT_END, booking_message
from deskmill.operators.availability import (
    NO_CONFLICTS,
    blocked_wishes,
    conflict_lists,
    conflict_pairs,
    conflicts,
    wished_span,
)
from deskmill.operators.ids import assign_ids
from deskmill.operators.intervals import label_islands, overlap_join
from deskmill.session import durable

# Fixed value: the message of a turned-down booking.
NOT_AVAILABLE = "Slot not available"
# Added here: a request without a calendar or a readable time can win nothing.
INCOMPLETE = "No calendar or time given"

MINUTE_US = 60_000_000

# Islands up to this many slots are folded by a built-in expression. Larger ones are settled
# in parallel rounds while a round settles this share of the open slots; what is left of them
# goes to a Python worker, at most BATCH_SLOTS of an island at a time.
FOLD_SLOTS = 200
LEAST_SHARE = 0.3
BATCH_SLOTS = 200_000

log = logging.getLogger(__name__)

_SLOT = "calendar_id bigint, _start bigint, _end bigint, arrival timestamp, request_id bigint"


def _open_slots(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """Distinct wished slots that no standing appointment blocks.

    Of the requests for one and the same slot only the earliest can win: what
    stands against it stands against the others too, and if it wins it is itself in
    their way. So one row per slot is left, found with a partial aggregate, and a
    busy calendar shrinks to its distinct slots before anything is joined. A
    blocked slot is turned down whatever else happens, which changes nothing.
    """
    slots = durable(
        requests.selectExpr(
            "calendar_id", *wished_span(requests), "struct(arrival, request_id) AS _turn"
        )
        .filter("calendar_id IS NOT NULL AND _start IS NOT NULL AND _end IS NOT NULL")
        .groupBy("calendar_id", "_start", "_end")
        .agg(F.min("_turn").alias("_first"))
        .selectExpr("calendar_id", "_start", "_end", "_first.arrival", "_first.request_id")
    )
    wishes = slots.withColumnRenamed("calendar_id", "_r_cal")
    blocked = blocked_wishes(wishes, appointments).select("request_id")
    return slots.join(blocked, "request_id", "left_anti")


def _in_islands(slots: DataFrame) -> DataFrame:
    """Slots with the island they compete in.

    Hulls are widened to whole minutes, and by a minute more for slots of no or
    negative length, which also compete with what merely touches them. Too wide a
    hull only makes an island larger, never wrong.
    """
    odd = f"CASE WHEN _end <= _start THEN {MINUTE_US}L ELSE 0L END"
    low, high = "least(_start, _end)", "greatest(_start, _end)"
    hulls = slots.selectExpr(
        "*",
        f"{low} - pmod({low}, {MINUTE_US}L) - {odd} AS _low",
        f"{high} + pmod(-{high}, {MINUTE_US}L) + {odd} AS _high",
    )
    return label_islands(hulls, "calendar_id", "_low", "_high")


def _fold(slots: DataFrame) -> DataFrame:
    """Admit slot by slot inside each (small) island."""
    clash = conflicts("x._start", "x._end", "a._start", "a._end")
    return (
        slots.groupBy("calendar_id", "island")
        .agg(F.expr("array_sort(collect_list(struct(arrival, request_id, _start, _end)))").alias("_queue"))
        .selectExpr(
            "calendar_id",
            f"""inline(aggregate(_queue, slice(_queue, 1, 0), (won, x) ->
                CASE WHEN exists(won, a -> {clash}) THEN won ELSE array_append(won, x) END))""",
        )
        .selectExpr("calendar_id", "_start", "_end", "arrival", "request_id")
    )


class _Admitted:
    """Slots admitted so far in one island."""

    def __init__(self) -> None:
        # proper slots never overlap each other, so both lists are sorted
        self.starts: list[int] = []
        self.ends: list[int] = []
        # Slots of no or negative length. One that starts no later and ends no earlier
        # than another never decides, so starts and ends both rise in these lists.
        self.odd_starts: list[int] = []
        self.odd_ends: list[int] = []

    def blocks(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        if before and self.ends[before - 1] > start:
            return True
        # such a slot is in the way iff it starts no earlier and ends no later
        at = bisect.bisect_left(self.odd_starts, start)
        return at < len(self.odd_ends) and self.odd_ends[at] <= end

    def add(self, start: int, end: int) -> None:
        if end > start:
            at = bisect.bisect_left(self.starts, start)
            self.starts.insert(at, start)
            self.ends.insert(at, end)
            return
        at = bisect.bisect_left(self.odd_starts, start)
        if at < len(self.odd_ends) and self.odd_ends[at] <= end:
            return
        upto = bisect.bisect_right(self.odd_starts, start)
        first = bisect.bisect_left(self.odd_ends, end, 0, upto)
        self.odd_starts[first:upto] = [start]
        self.odd_ends[first:upto] = [end]


def _admit(island: pd.DataFrame) -> pd.DataFrame:
    queue = island.sort_values(["arrival", "request_id"], kind="stable")
    admitted = _Admitted()

    def wins() -> Iterator[bool]:
        for start, end in zip(queue["_start"].tolist(), queue["_end"].tolist()):
            free = not admitted.blocks(start, end)
            if free:
                admitted.add(start, end)
            yield free

    return queue[list(wins())][["calendar_id", "_start", "_end", "arrival", "request_id"]]


def _earliest(slots: DataFrame, batch_slots: int) -> tuple[DataFrame, DataFrame]:
    """Split each island into about its earliest ``batch_slots`` and the rest.

    Slots are numbered by arrival with a range sort; the cut per island is a
    quantile of these numbers (a mergeable sketch), so no task sees a whole island.
    Any cut that is a prefix of the arrivals is right, but both parts must see the same
    one: the sketch may differ from run to run, so the cuts are written down.
    """
    numbered = durable(assign_ids(slots, None, ["arrival", "request_id"], "_turn"))
    halves = ", ".join(f"{0.5 ** n!r}D" for n in range(1, 41))
    cuts = durable(
        numbered.groupBy("calendar_id", "island")
        .agg(
            F.count("*").alias("_slots"),
            F.expr(f"percentile_approx(_turn, array({halves}), 100000)").alias("_at"),
        )
        .selectExpr(
            "calendar_id",
            "island",
            f"""CASE WHEN _slots > {batch_slots}
                THEN _at[cast(ceil(log2(_slots / {batch_slots})) AS int) - 1] END AS _cut""",
        )
    )
    split = numbered.join(cuts, ["calendar_id", "island"])
    now = "_cut IS NULL OR _turn <= _cut"
    return tuple(
        split.filter(part).drop("_turn", "_cut") for part in (now, f"NOT ({now})")
    )


def _reach(slots: DataFrame, top: Column) -> DataFrame:
    """Slots once per dyadic cell of their hull: ``_level, _cell, _whole``.

    A cell of level ``j`` is a run of ``2^j`` minutes. A hull is made up of the largest cells
    that lie in it (``_whole``), at most two per level; above them are the cells it fills in
    part, at most two per level again, up to the level ``top`` that no hull fills.
    """
    odd = "CASE WHEN _end <= _start THEN 1 ELSE 0 END"
    hulls = slots.selectExpr(
        "*",
        f"least(_start, _end) div {MINUTE_US}L - {odd} AS _lo",
        f"-((-greatest(_start, _end)) div {MINUTE_US}L) + {odd} AS _hi",
    ).withColumn("_top", top)
    parts = """flatten(transform(sequence(0, _top), j -> filter(array(
        named_struct('l', j, 'c', -shiftright(-_lo, j), 'w', true),
        named_struct('l', j, 'c', shiftright(_hi, j) - 1, 'w', true),
        named_struct('l', j, 'c', shiftright(_lo, j), 'w', false),
        named_struct('l', j, 'c', shiftright(_hi - 1, j), 'w', false)), x -> CASE
            WHEN x.w THEN shiftleft(x.c, j) >= _lo AND shiftleft(x.c + 1, j) <= _hi
                AND (j = _top OR shiftleft(shiftright(x.c, 1), j + 1) < _lo
                    OR shiftleft(shiftright(x.c, 1) + 1, j + 1) > _hi)
            ELSE shiftleft(x.c, j) < _lo OR shiftleft(x.c + 1, j) > _hi END)))"""
    cells = hulls.select("calendar_id", "request_id", "arrival", F.explode(F.array_distinct(F.expr(parts))).alias("_x"))
    return cells.select(
        "calendar_id",
        F.col("_x.l").alias("_level"),
        F.col("_x.c").alias("_cell"),
        F.col("_x.w").alias("_whole"),
        F.struct("arrival", "request_id").alias("_rank"),
    )


def _first_in_reach(slots: DataFrame) -> DataFrame:
    """``request_id`` of the slots that come before every other slot whose hull meets theirs.

    Two hulls meet where a whole cell of one lies in, or holds, a whole cell of the other. So
    per cell the earliest slot that fills it wholly and the earliest that reaches into it, both
    found with partial aggregates, are all a slot needs to see: no pairs are formed, however
    many slots share a minute.
    """
    longest = slots.selectExpr(f"max(abs(_end - _start)) div {MINUTE_US}L + 3 AS n").first().n or 1
    cells = _reach(slots, F.lit(int(longest).bit_length()))
    earliest = cells.groupBy("calendar_id", "_level", "_cell").agg(
        F.min("_rank").alias("_reaching"), F.min(F.when(F.col("_whole"), F.col("_rank"))).alias("_filling")
    )
    seen = cells.join(earliest, ["calendar_id", "_level", "_cell"]).withColumn(
        "_least", F.when(F.col("_whole"), F.col("_reaching")).otherwise(F.col("_filling"))
    )
    # nulls, of cells that nothing fills, do not count
    return (
        seen.groupBy("_rank")
        .agg(F.min("_least").alias("_least"))
        .filter("_least = _rank")
        .select(F.col("_rank.request_id").alias("request_id"))
    )


def _settle(slots: DataFrame, columns: list[str], least_share: float) -> tuple[DataFrame | None, DataFrame]:
    """``(winners, still open)`` after rounds of parallel admission over all slots at once.

    A round admits each slot that is earlier than all open slots it could meet, and drops what
    the admitted ones beat. In chance order a few rounds settle nearly all; where arrivals
    follow the calendar, each slot waits for the one before it, and a round settles little.
    So rounds go on only while each settles at least ``least_share`` of what was open.
    """
    won: DataFrame | None = None
    open_, left = slots, slots.count()
    while left:
        first = durable(open_.join(_first_in_reach(open_), "request_id", "left_semi").select(*columns))
        taken = first.selectExpr("calendar_id AS _w_cal", "_start AS _w_start", "_end AS _w_end")
        others = open_.join(first.select("request_id"), "request_id", "left_anti")
        beaten = overlap_join(
            others,
            taken,
            ("calendar_id", "_w_cal"),
            ("_start", "_end"),
            ("_w_start", "_w_end"),
            conflicts("_start", "_end", "_w_start", "_w_end"),
            "left_semi",
        )
        open_ = durable(others.join(beaten.select("request_id"), "request_id", "left_anti").select(*columns))
        won = first if won is None else won.unionByName(first)
        before, left = left, open_.count()
        log.info("admission round: %d of %d slots settled", before - left, before)
        if before - left < least_share * before:
            break
    return won, open_


def admit(
    slots: DataFrame,
    fold_slots: int = FOLD_SLOTS,
    batch_slots: int = BATCH_SLOTS,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """The slots that win when each calendar is served in arrival order.

    Slots of different islands never meet, so islands are served side by side. Islands of up
    to ``fold_slots`` are folded in the JVM. Larger ones are settled in parallel rounds over
    all their slots (:func:`_settle`), which leaves smaller islands. Where that gains too
    little, because the slots wait for one another in a chain, an island takes about its
    earliest ``batch_slots`` in one task; what collides with the winners drops out, and the
    rest goes on to the next round. Every round settles some slots of each large island, and
    nothing is left over at the end.
    """
    columns = ["calendar_id", "_start", "_end", "arrival", "request_id"]
    group = ["calendar_id", "island"]
    winners: DataFrame | None = None
    pending = durable(slots)
    parallel = True
    while True:
        pending = durable(_in_islands(pending).select(*columns, "island"))
        sizes = pending.groupBy(*group).agg(F.count("*").alias("_slots"))
        largest = sizes.agg(F.max("_slots")).first()[0] or 0
        waiting = None
        if largest <= fold_slots:
            won = _fold(pending)
        else:
            big = sizes.filter(F.col("_slots") > fold_slots).select(*group)
            head = pending.join(big, group, "left_semi")
            small = _fold(pending.join(big, group, "left_anti"))
            if parallel:
                first, waiting = _settle(durable(head.select(*columns)), columns, least_share)
                won, parallel = small.unionByName(first), False
            else:
                if largest > batch_slots:
                    head, waiting = _earliest(head, batch_slots)
                won = small.unionByName(head.groupBy(*group).applyInPandas(_admit, _SLOT))
        if waiting is not None:
            won = durable(won)
        winners = won if winners is None else winners.unionByName(won)
        if waiting is None:
            return winners
        if "island" not in waiting.columns:  # rounds have dropped what their winners beat
            pending = waiting
            continue
        parallel = True
        taken = won.selectExpr("calendar_id AS _w_cal", "_start AS _w_start", "_end AS _w_end")
        beaten = overlap_join(
            waiting,
            taken,
            ("calendar_id", "_w_cal"),
            ("_start", "_end"),
            ("_w_start", "_w_end"),
            conflicts("_start", "_end", "_w_start", "_w_end"),
            "left_semi",
        )
        pending = durable(
            waiting.join(beaten.select("request_id"), "request_id", "left_anti").select(*columns)
        )


def accept(
    requests: DataFrame, appointments: DataFrame, existing_ids: DataFrame | None = None
) -> DataFrame:
    """Accepted requests with their new ``appointment_id``, in arrival order.

    New ids follow the highest id of ``existing_ids``, by default of
    ``appointments``; give it where ``appointments`` is only the relevant part.
    """
    won = admit(_open_slots(requests, appointments)).select("request_id")
    accepted = requests.join(won, "request_id", "left_semi")
    known = (appointments if existing_ids is None else existing_ids).selectExpr("id AS appointment_id")
    # every caller reads the accepted rows several times
    return durable(assign_ids(accepted, known, ["arrival", "request_id"], "appointment_id"))


def as_booked(accepted: DataFrame) -> DataFrame:
    """Accepted requests in the shape later arrivals see them."""
    return accepted.selectExpr(
        "appointment_id AS id",
        "calendar_id",
        "title",
        "start",
        f"{SLOT_END} AS end",
        "arrival AS since_ts",
        "request_id AS since_id",
    )


def book(requests: DataFrame, appointments: DataFrame) -> DataFrame:
    """Outcome per request: ``success, appointment_id, message, conflicts``.

    A request is accepted iff nothing standing and nothing accepted before it is in
    its way. ``conflicts`` of a turned-down request lists what was.
    """
    return outcomes(requests, appointments, accept(requests, appointments))


def outcomes(requests: DataFrame, appointments: DataFrame, accepted: DataFrame) -> DataFrame:
    """What ``book`` reports, given the rows that ``accept`` found."""
    ids = accepted.select("request_id", "appointment_id")
    turned_down = requests.join(ids, "request_id", "left_anti")
    reasons = conflict_lists(conflict_pairs(turned_down, appointments, as_booked(accepted)))
    booked = F.col("appointment_id").isNotNull()
    end = wished_span(requests)[1].removesuffix(" AS _end")
    incomplete = F.expr(f"calendar_id IS NULL OR start IS NULL OR ({end}) IS NULL")
    return (
        requests.join(ids, "request_id", "left")
        .join(reasons, "request_id", "left")
        .withColumns(
            {
                "success": booked,
                "message": F.when(booked, booking_message(F.col("start")))
                .when(incomplete, INCOMPLETE)
                .otherwise(NOT_AVAILABLE),
                "conflicts": F.expr(f"coalesce(conflicts, {NO_CONFLICTS})"),
            }
        )
    )


def appointment_rows(accepted: DataFrame) -> DataFrame:
    """Accepted requests as rows of the appointments table, defaults filled in."""
    have = set(accepted.columns)

    def given(name: str, kind: str, default: str) -> str:
        value = f"coalesce({name}, {default})" if name in have else default
        return f"cast({value} AS {kind}) AS {name}"

    return accepted.selectExpr(
        "appointment_id AS id",
        "calendar_id",
        "title",
        given("description", "string", "''"),
        "start",
        f"{SLOT_END} AS end",
        given("attendees", "array<string>", "cast(array() AS array<string>)"),
        "'confirmed' AS status",
        "arrival AS created_at",
        given("call_log_id", "bigint", "NULL"),
        given("created_by", "string", "'system'"),
    )
