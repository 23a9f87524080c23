"""Best-fit packing of token sequences with swap-based local search.

Documents longer than a sequence are cut; what remains are pieces of 1 to
``capacity`` tokens. Pieces of one length are interchangeable, so the packing is
planned on the number of pieces per length: a table of at most ``capacity`` rows,
whatever the size of the corpus. The plan is a list of bin kinds (multisets of
lengths, each with the number of bins that look so):

1. best fit, longest first, places whole runs of equal lengths at a time;
2. local search empties the bins with the most room: a piece of the emptiest bin
   moves into another bin with room, or is exchanged for one or two shorter pieces
   of another bin, or two are exchanged for one, always so that the sum of squared
   fills increases.

Spark then numbers the pieces of every length (in salted groups, so that a frequent
length is no hot key) and looks up each number's place in the plan.

Null and empty texts are documents of one token (the end id). Repeated rows are
packed each for itself; an empty table gives an empty result; only id and text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.tokens import encoder, vocabulary
from deskmill.session import durable

CAPACITY = 2048
# Groups that the pieces of one length are numbered in.
SALTS = 64
# Steps after which local search ends; the plan is complete at any step.
MAX_STEPS = 2_000
# Bins in a row that no step improves before it ends as well: those left are fuller still.
MAX_FAILURES = 12


# -- pieces ------------------------------------------------------------------


def cut_pieces(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the token pieces of every text."""
    path = path or vocabulary()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            rows: list[tuple] = []
            for at, ids in enumerate(encode(batch.column(1).to_pylist())):
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part), part))
            if not rows:
                continue
            at, piece, start, length, crc, part = zip(*rows)
            columns = [
                batch.column(0).take(pa.array(at, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(part, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


# -- the plan ----------------------------------------------------------------


@dataclass
class Kind:
    """Bins that hold the same lengths."""

    items: list[int]
    bins: int
    room: int = field(default=0)


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Bin kinds of best fit, longest lengths first, a run of equal lengths at a time."""
    by_room: dict[int, list[Kind]] = {}
    rooms: list[int] = []  # sorted rooms that some kind has

    def add(kind: Kind) -> None:
        if kind.room not in by_room:
            by_room[kind.room] = []
            bisect.insort(rooms, kind.room)
        by_room[kind.room].append(kind)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if left >= each:
                    add(Kind([length] * each, left // each, capacity - each * length))
                if left % each:
                    n = left % each
                    add(Kind([length] * n, 1, capacity - n * length))
                break
            room = rooms[at]
            kind = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = min(room // length, left)
            bins = min(kind.bins, left // each)
            if bins < kind.bins:
                add(Kind(kind.items, kind.bins - bins, room))
            add(Kind(kind.items + [length] * each, bins, room - each * length))
            left -= bins * each
    return [k for kinds in by_room.values() for k in kinds]


def local_search(kinds: list[Kind], capacity: int, max_steps: int = MAX_STEPS) -> list[Kind]:
    """Empty the least filled bins by moves and exchanges with other bins that have room.

    Each step fills a bin more at the cost of an emptier one, so the sum of squared
    fills rises. Single bins are split off their kind before they are changed.
    """
    total = sum(sum(k.items) * k.bins for k in kinds)
    least = -(-total // capacity)
    full = [k for k in kinds if k.room == 0]
    loose = [k for k in kinds if k.room > 0]
    steps = failures = 0
    loose.sort(key=lambda k: k.room)
    while loose and failures < MAX_FAILURES and steps < max_steps and sum(k.bins for k in full) + sum(k.bins for k in loose) > least:
        kind = loose.pop()
        donor = Kind(sorted(kind.items), 1, kind.room)
        kind = Kind(kind.items, kind.bins - 1, kind.room)
        before = steps
        changed = True
        while donor.items and changed and steps < max_steps:
            changed = False
            for at in range(len(loose) - 1, -1, -1):  # those with most room gain most
                other = loose[at]
                step = _exchange(donor, other, capacity)
                if step is None:
                    continue
                given, taken = step
                steps += 1
                changed = True
                rest = Kind(other.items, other.bins - 1, other.room)
                items = sorted(other.items)
                for x in taken:
                    items.remove(x)
                    bisect.insort(donor.items, x)
                for x in given:
                    donor.items.remove(x)
                    bisect.insort(items, x)
                merged = Kind(items, 1, capacity - sum(items))
                donor.room = capacity - sum(donor.items)
                if rest.bins:
                    loose[at] = rest
                else:
                    del loose[at]
                if merged.room:
                    bisect.insort(loose, merged, key=lambda k: k.room)
                else:
                    full.append(merged)
                break
        failures = failures + 1 if donor.items else 0
        if donor.items:
            full.append(donor)  # nothing improves it any more
        if kind.bins:  # nor its like, if nothing did
            if steps == before:
                full.append(kind)
            else:
                bisect.insort(loose, kind, key=lambda k: k.room)
    return full + loose


def _exchange(donor: Kind, other: Kind, capacity: int) -> tuple[list[int], list[int]] | None:
    """What the donor gives and takes so that ``other`` gains most, or None.

    ``other`` must be at least as full as the donor, which makes any gain of its
    fill an increase of the sum of squares.
    """
    room = other.room
    if room == 0 or room > donor.room:
        return None
    mine, theirs = sorted(set(donor.items)), sorted(set(other.items))
    best: tuple[int, list[int], list[int]] = (0, [], [])

    def offer(given: list[int], taken: list[int]) -> None:
        nonlocal best
        gain = sum(given) - sum(taken)
        if best[0] < gain <= room:
            best = (gain, given, taken)

    at = bisect.bisect_right(mine, room)
    if at:
        return [mine[at - 1]], []  # a move
    for t in theirs:  # one for one
        at = bisect.bisect_right(mine, t + room)
        if at:
            offer([mine[at - 1]], [t])
    if best[0] < room:
        for i, t in enumerate(theirs):  # one for two of theirs
            for u in theirs[i:]:
                if t == u and other.items.count(t) < 2:
                    continue
                at = bisect.bisect_right(mine, t + u + room)
                if at:
                    offer([mine[at - 1]], [t, u])
    if best[0] < room:
        for i, m in enumerate(mine):  # two for one of theirs
            for n in mine[i:]:
                if m == n and donor.items.count(m) < 2:
                    continue
                at = bisect.bisect_left(theirs, m + n - room)
                if at < len(theirs) and theirs[at] < m + n:
                    offer([m, n], [theirs[at]])
    return (best[1], best[2]) if best[0] else None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, max_steps: int = MAX_STEPS) -> list[Kind]:
    """Bin kinds for ``counts`` pieces per length."""
    return local_search(best_fit(counts, capacity), capacity, max_steps)


def runs_of(kinds: list[Kind]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first rank, first sequence, offset)`` in rank order: the pieces
    with ranks from there on go to consecutive sequences at that offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for kind in kinds:
        offset = 0
        for length in kind.items:
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + kind.bins
            offset += length
        sequence += kind.bins
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


# -- packing -----------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_steps: int = MAX_STEPS) -> DataFrame:
    """``pieces`` (a written table with ``doc_id``, ``piece``, ``length``) with ``sequence_id``
    and ``offset``. Sequences are numbered from 0, and each is filled without gaps."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("salt_", salt)
    table = salted.groupBy("length", "salt_").count().collect()  # at most capacity * SALTS rows
    by_salt = np.zeros((capacity + 1, SALTS), np.int64)
    for length, s, n in table:
        by_salt[length, s] = n
    counts = {int(n): int(c) for n, c in enumerate(by_salt.sum(axis=1)) if c}
    before = np.cumsum(by_salt, axis=1) - by_salt
    runs = runs_of(plan_bins(counts, capacity, max_steps))

    ranked = salted.withColumn(
        "rank_",
        F.row_number().over(Window.partitionBy("length", "salt_").orderBy("doc_id", "piece")),
    )
    at = {c: i for i, c in enumerate(ranked.columns)}
    kept = [c for c in ranked.columns if c not in ("salt_", "rank_")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = batch.column(at["length"]).to_numpy()
            rank = batch.column(at["rank_"]).to_numpy() - 1
            rank = rank + before[length, batch.column(at["salt_"]).to_numpy()]
            sequence = np.empty(len(length), np.int64)
            offset = np.empty(len(length), np.int64)
            for value in np.unique(length):
                own = np.flatnonzero(length == value)
                table = runs[int(value)]
                run = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                sequence[own] = table[run, 1] + rank[own] - table[run, 0]
                offset[own] = table[run, 2]
            columns = [batch.column(at[c]) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    fields = [*(pieces.schema[c] for c in kept)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """All documents of ``df`` cut, encoded and packed, one row per piece."""
    return pack(durable(cut_pieces(df, doc_id, text, **settings)), settings.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of whole sequences, from pieces cut ``with_ids``.

    A sequence holds at most its capacity, so its group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(p, cast('' as binary), (all, x) -> concat(all, x.ids))")
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", joined.alias("ids"))
