"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the words of a text and one end. The tree's states are contexts of up to
``DEPTH`` words. A context is a candidate where it occurs ``MIN_CONTEXT`` times in the
training documents; its distribution over next symbols discounts the counts of symbols
seen ``MIN_ENTRY`` times and gives the mass that is left to the distribution of the context
one word shorter, so ::

    p(x | s) = (n(s x) - d) / n(s) + rest(s) p(x | shorter s)     x seen after s
    p(x | s) = rest(s) p(x | shorter s)                           otherwise

down to the empty context, whose distribution is the base model. A candidate is retained
where the divergence from the shorter context, in nats over its occurrences, pays
``GAIN`` for each stored symbol and for itself; contexts shorter than a retained one stay
as well. A text is scored by the longest state before each of its symbols.

The logarithm of that product is a plain sum over the text's word sequences: the base of
each symbol, ``log rest(s)`` for each state that occurs, and for each stored ``(s, x)`` that
occurs ``log p(x | s) - log p(x | shorter s) - log rest(s)``. So the model is one table of
weights by sequence, and scoring is a join with the sequences of the documents. The most
frequent weights (at most ``HEAD``) go to every task; the others, each of them rare, are
joined by key. Fixed bitmaps of hash slots keep sequences out that can be in no table.
They grow fuller with the corpus, which costs time, never a result.

Sequences are known by 64-bit hashes. Those of single words are verified: should two words
of the corpus share one, all are hashed anew with the next seed, so ``n_known`` and
``base_score`` are exact. Longer sequences are not verified; two of them sharing a hash
would share their counts.

Null texts are empty and consist of the end alone. Rows without an id are held out, as if
their id were the empty text. Repeated rows count each for itself, in training too. An
empty table gives no rows; without training documents all symbols are unknown and both
scores use ``N = V = 0``. Columns besides id and text are not read. Texts of any length
are hashed in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import text_or_empty
from deskmill.session import durable

# Weights that every task holds, at most.
HEAD = 1 << 20
# Contexts that hold this share of all training symbols spread over several tasks.
HOT_SHARE = 4096
SALTS = 64
# Symbols that a task counts at a time, symbols it reads at a time where more would save nothing, and bytes it
# hashes at a time.
CHUNK = 1 << 21
READ = 1 << 19
PIECE = 1 << 20
# Slots of a bitmap are the first 26 bits of a key: at most 2^20 lanes of 64 bits.
_LANE_SHIFT, _SLOT_SHIFT, _LANES = 44, 38, 1 << 20
# Of the base model: what each symbol, and one unknown symbol, have beyond their count.
EXTRA = 0.1


@dataclass(frozen=True)
class Growth:
    """What decides about the tree."""

    depth: int = 2
    min_context: int = 32
    min_entry: int = 4
    discount: float = 0.75
    gain: float = 1.0


# -- symbols -------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Odd, so that multiplying keeps keys apart.
STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 0xD1342543DE82EF95
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Hasher:
    """Words of UTF-8 texts as 64-bit symbols, all words of a piece at once."""

    def __init__(self, seed: int):
        start = np.uint64((seed * 1_000_003 + 1) % (1 << 64))
        self.codes = _mix(np.arange(1, 257, dtype=np.uint64) * STEP + start)[_LOWER]
        self.end = _mix(np.array([start ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]
        self.places = np.ones(1, np.uint64)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, starts and sizes of the words, and their bytes in lower case."""
        solid = ~_BLANK[data]
        edges = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, sizes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = sizes - starts
        body = data[solid]
        if not len(starts):
            return np.zeros(0, np.uint64), starts, sizes, body
        longest = int(sizes.max())
        if longest > len(self.places):
            self.places = np.cumprod(np.full(longest, _PLACE, np.uint64))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(body)) - np.repeat(first, sizes)
        sums = np.add.reduceat(self.codes[body] * self.places[place], first)
        return _mix(sums + sizes.astype(np.uint64) * STEP), starts, sizes, _LOWER[body]

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``symbols, per_text, sizes, body`` of all words of all texts, in order."""
        found, per_text = [], np.zeros(len(texts), np.int64)
        for first, last, data in _pieces(texts):
            symbols, starts, sizes, body = self._piece(data)
            if last == first + 1:  # one text, or a part of one
                per_text[first] += len(symbols)
            else:
                ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
                below = np.searchsorted(starts, ends)
                per_text[first:last] += np.diff(below, prepend=0)
            found.append((symbols, sizes, body))
        if not found:
            return np.zeros(0, np.uint64), per_text, np.zeros(0, np.int64), np.zeros(0, np.uint8)
        symbols, sizes, body = (np.concatenate(parts) for parts in zip(*found))
        return symbols, per_text, sizes, body

    def symbols(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols with an end after each text, and the symbols per text."""
        words, per_text, _, _ = self.words(texts)
        out = np.full(len(words) + len(texts), self.end, np.uint64)
        out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), per_text)] = words
        return out, per_text + 1


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)


def _pieces(texts: Sequence[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first, last, bytes``: runs of short texts, and long ones cut between words."""
    first, size = 0, 0
    for i, text in enumerate([*texts, None]):
        if text is None or size + len(text) > PIECE:
            if i > first:
                yield first, i, _bytes(b"\n".join(texts[first:i]))
            first, size = i, 0
        if text is None:
            return
        if len(text) <= PIECE:
            size += len(text)
            continue
        data, at = _bytes(text), 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not _BLANK[data[end]]:
                cut = np.flatnonzero(_BLANK[data[end : end + PIECE]])
                end = end + int(cut[0]) if len(cut) else min(end + PIECE, len(data))
            yield i, i + 1, data[at:end]
            at = end
        first = i + 1


def keys_before(symbols: np.ndarray, per_text: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``depth`` symbols: the key of those up to each position, and where all lie in its text."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    key, factor = np.zeros(len(symbols), np.uint64), STEP
    for back in range(depth):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[back:] = symbols[: len(symbols) - back] if back else symbols
        key = key + shifted * factor
        factor = np.uint64(int(factor) * int(STEP) % (1 << 64))
        yield key, place >= back


class Slots:
    """A fixed bitmap of keys: never misses one, may take others for one."""

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes

    def has(self, keys: np.ndarray) -> np.ndarray:
        bits = self.lanes[(keys >> np.uint64(_LANE_SHIFT)).astype(np.int64)]
        return (bits >> ((keys >> np.uint64(_SLOT_SHIFT)) & np.uint64(63))) & np.uint64(1) == 1


class Lookup:
    """Positions of keys in a sorted array, found through the first position of each lane."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        lanes = np.arange(_LANES + 1, dtype=np.uint64) << np.uint64(_LANE_SHIFT)
        self.first = np.searchsorted(keys, lanes[:-1]).astype(np.int32)
        self.last = np.append(self.first[1:], np.int32(len(keys)))

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The position of each key asked for, or -1."""
        lane = (asked >> np.uint64(_LANE_SHIFT)).astype(np.int32)
        at, last = self.first[lane], self.last[lane]
        out = np.full(len(asked), -1, np.int32)
        left = np.flatnonzero(at < last)
        while len(left):
            here = self.keys[at[left]]
            hit = here == asked[left]
            out[left[hit]] = at[left[hit]]
            left = left[here < asked[left]]
            at[left] += 1
            left = left[at[left] < last[left]]
        return out


def slots(keys: DataFrame, key: str) -> Slots:
    """The bitmap of a column of keys, put together by Spark: at most 2^20 rows come back."""
    rows = (
        keys.groupBy(F.expr(f"cast(shiftrightunsigned({key}, {_LANE_SHIFT}) AS int)").alias("lane"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned({key}, {_SLOT_SHIFT}) & 63 AS int)))").alias("bits"))
        .toArrow()
    )
    lanes = np.zeros(_LANES, np.uint64)
    lanes[rows.column("lane").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Slots(lanes)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch], at: int, symbols: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Batches put together until they hold some ``6 symbols`` bytes, with their texts."""
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        part = batch.column(at).cast(pa.binary()).to_pylist()
        texts += part
        size += sum(map(len, part))
        if size > 6 * symbols:
            yield held, texts
            held, texts, size = [], [], 0
    if texts:
        yield held, texts


# -- counting ------------------------------------------------------------------


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter("NOT held_out").select("text")


def _vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """``symbol, word, n``: all words, and how often each occurs in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        for held, texts in _chunks(batches, 1, CHUNK):
            symbols, per_text, sizes, body = hasher.words(texts)
            if not len(symbols):
                continue
            learned = ~np.concatenate([np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool) for b in held])
            unique, first, back = np.unique(symbols, return_index=True, return_inverse=True)
            n = np.bincount(back, np.repeat(learned, per_text), len(unique)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())]
            words = pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).take(pa.array(first))
            columns = [_signed(unique), words.cast(pa.binary()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["symbol", "word", "n"])

    found = docs.select("held_out", "text").mapInArrow(run, "symbol long, word string, n long")
    return found.groupBy("symbol", "word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[int, DataFrame]:
    """A seed under which no two words of the corpus, nor a word and the end, share a symbol,
    and ``symbol, n`` of all training symbols."""
    seed = 0
    while True:
        words = durable(_vocabulary(docs, seed))
        shared = words.groupBy("symbol").agg(F.count("*").alias("words")).filter("words > 1")
        end = int(Hasher(seed).end.view(np.int64))
        if shared.isEmpty() and words.filter(F.col("symbol") == end).isEmpty():
            break
        seed += 1
    ends = _training(docs).agg(F.lit(end).alias("symbol"), F.count("*").alias("n"))
    return seed, words.select("symbol", "n").unionByName(durable(ends)).filter("n > 0")


def _extended(df: DataFrame, keys: dict[str, str], symbol: str) -> DataFrame:
    """``df`` with new columns: the keys ``keys`` names, with ``symbol`` after them."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{k} long" for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def column(name: str) -> np.ndarray:
                return batch.column(batch.schema.get_field_index(name)).to_numpy().view(np.uint64)

            new = [_signed((column(source) + column(symbol)) * STEP) for source in keys.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *keys])

    return df.mapInArrow(run, schema)


def _counted(context: np.ndarray, symbol: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
    """One row per context and salt: the symbols after it, and how often each is. Contexts in ``large`` have salts."""
    salt = np.zeros(len(context), np.int32)
    if len(large):
        salt = np.where(np.isin(context, large), symbol % np.uint64(SALTS), np.uint64(0)).astype(np.int32)
    order = np.lexsort((symbol, salt, context))
    context, symbol, salt = context[order], symbol[order], salt[order]
    new_run = np.ones(len(order), bool)
    new_run[1:] = (context[1:] != context[:-1]) | (salt[1:] != salt[:-1])
    new = new_run.copy()
    new[1:] |= symbol[1:] != symbol[:-1]
    starts = np.flatnonzero(new)
    n = np.diff(starts, append=len(order)).astype(np.int32)
    runs = np.flatnonzero(new_run)
    offsets = pa.array(np.append(np.searchsorted(starts, runs), len(starts)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            _signed(context[runs]),
            pa.array(salt[runs]),
            pa.ListArray.from_arrays(offsets, _signed(symbol[starts])),
            pa.ListArray.from_arrays(offsets, pa.array(n)),
        ],
        names=["context", "salt", "symbols", "counts"],
    )


def _entries(docs: DataFrame, seed: int, depth: int, contexts: DataFrame, symbols: Slots, total: int, least: int) -> DataFrame:
    """``context, symbol, n`` of the symbols seen at least ``least`` times after a context of ``depth`` words.

    A task counts ``CHUNK`` symbols that pass both bitmaps at a time and sends one row per context with all
    its symbols. A context with a large share of the corpus is dealt by symbol as well.
    """
    known = slots(contexts, "context")
    # at most HOT_SHARE rows: their counts together are no more than all symbols
    hot = np.sort(
        np.array([r.context for r in contexts.filter(F.col("c") * HOT_SHARE >= total).select("context").collect()], np.int64)
    ).view(np.uint64)
    spread = docs.sparkSession.sparkContext.broadcast((known.lanes, symbols.lanes, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        lanes, frequent, large = spread.value
        known, frequent = Slots(lanes), Slots(frequent)
        contexts, following, held = [], [], 0
        for _, texts in _chunks(batches, 0, min(READ, CHUNK)):
            found, per_text = hasher.symbols(texts)
            for key, inside in keys_before(found, per_text, depth):
                pass
            first = np.cumsum(per_text) - per_text
            follows = np.ones(len(found), bool)
            follows[first] = False
            follows[1:] &= inside[:-1]
            at = np.flatnonzero(follows)
            at = at[frequent.has(found[at])]
            at = at[known.has(key[at - 1])]
            contexts.append(key[at - 1])
            following.append(found[at])
            held += len(at)
            if held >= CHUNK:
                yield _counted(np.concatenate(contexts), np.concatenate(following), large)
                contexts, following, held = [], [], 0
        if held:
            yield _counted(np.concatenate(contexts), np.concatenate(following), large)

    dealt = _training(docs).mapInArrow(run, "context long, salt int, symbols array<long>, counts array<int>")
    pairs = dealt.repartition("context", "salt").select("context", "salt", F.explode(F.arrays_zip("symbols", "counts")).alias("e"))
    return (
        pairs.select("context", "salt", F.col("e.symbols").alias("symbol"), F.col("e.counts").alias("n"))
        .groupBy("context", "salt", "symbol")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
        .drop("salt")
    )


# -- the tree ------------------------------------------------------------------


def base_share(n: Column | int, total: int, symbols: int) -> Column:
    """Share of a symbol seen ``n`` times in the base model."""
    n = F.lit(n) if isinstance(n, int) else n
    return (n + EXTRA) / (total + EXTRA * (symbols + 1))


def _level(entries: DataFrame, contexts: DataFrame, lower: DataFrame, growth: Growth) -> tuple[DataFrame, DataFrame]:
    """``(shares, candidates)`` of one depth: entries and contexts with what they weigh.

    ``lower`` gives ``parent, symbol, q``: the shares after the contexts one word shorter, or
    ``symbol, q`` at the first depth.
    """
    on = [c for c in ("parent", "symbol") if c in lower.columns]
    if "parent" in on:
        rows = entries.join(contexts, "context").join(lower, on)
    else:
        rows = entries.join(lower, on).join(contexts, "context")
    d = growth.discount
    rest = rows.groupBy("context").agg(((F.max("c") - F.sum("n") + d * F.count("*")) / F.max("c")).alias("rest"))
    # sorted by context as written, so what belongs to a context takes next to no room
    shares = durable(
        rows.join(rest, "context")
        .withColumn("p", (F.col("n") - d) / F.col("c") + F.col("rest") * F.col("q"))
        .selectExpr("context", "c", "rest", "symbol", "n", "p", "q")
    )
    seen = shares.groupBy("context").agg(
        F.max("c").alias("c"),
        F.max("rest").alias("rest"),
        F.count("*").alias("held"),
        F.expr("sum(p * ln(p / q)) + max(rest * ln(rest)) * greatest(1 - sum(q), 0)").alias("apart"),
    )
    return shares, durable(seen.selectExpr("context", "c", "rest", f"c * apart >= {growth.gain!r} * (held + 1) AS pays"))


@dataclass
class Tree:
    """The model: its weights by key, and what the base needs."""

    seed: int
    depth: int
    train_tokens: int
    train_symbols: int
    weights: DataFrame  # key, kind (1: single symbol), n, base, extra


def grow(docs: DataFrame, growth: Growth = Growth()) -> Tree:
    """The suffix tree of the training rows of ``docs`` (``held_out, text``)."""
    seed, symbols = vocabulary(docs)
    size = symbols.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = size.n or 0, size.v
    unknown = math.log10(EXTRA / (total + EXTRA * (distinct + 1)))
    end = int(Hasher(seed).end.view(np.int64))
    zero = F.lit(0).cast("long")
    words = _extended(symbols.withColumn("root", zero), {"key": "root"}, "symbol")
    singles = words.select("key", "n", (F.log10(base_share(F.col("n"), total, distinct)) - unknown).alias("base"))

    frequent = slots(symbols.filter(F.col("n") >= growth.min_entry), "symbol")
    contexts = words.filter((F.col("n") >= growth.min_context) & (F.col("symbol") != end)).select(
        F.col("key").alias("context"), F.col("root").alias("parent"), F.col("n").alias("c")
    )
    lower = symbols.select("symbol", base_share(F.col("n"), total, distinct).alias("q"))
    levels = []
    for depth in range(1, growth.depth + 1):
        contexts = durable(contexts)
        entries = durable(_entries(docs, seed, depth, contexts, frequent, total, growth.min_entry))
        shares, candidates = _level(entries, contexts, lower, growth)
        levels.append((shares, candidates.join(contexts.select("context", "parent"), "context")))
        longer = shares.filter((F.col("n") >= growth.min_context) & (F.col("symbol") != end))
        longer = longer.select("context", "symbol", "n").join(contexts.select("context", "parent"), "context")
        contexts = _extended(longer, {"longer": "context", "shorter": "parent"}, "symbol").select(
            F.col("longer").alias("context"), F.col("shorter").alias("parent"), F.col("n").alias("c")
        )
        lower = shares.select(F.col("context").alias("parent"), "symbol", F.col("p").alias("q"))

    none, parts, needed = F.lit(0.0), [], None
    for shares, candidates in reversed(levels):
        states = candidates.filter("pays")
        if needed is not None:
            states = states.unionByName(candidates.filter("NOT pays").join(needed, "context", "left_semi"))
        states = durable(states)
        entry = _extended(shares.join(states.select("context"), "context", "left_semi"), {"key": "context"}, "symbol")
        parts.append(entry.select("key", "n", none.alias("base"), F.expr("log10(p / q) - log10(rest)").alias("extra"), none.alias("kind")))
        parts.append(
            states.select(F.col("context").alias("key"), F.col("c").alias("n"), none.alias("base"), F.log10("rest").alias("extra"), none.alias("kind"))
        )
        needed = states.select(F.col("parent").alias("context"))
    parts.append(singles.select("key", "n", "base", none.alias("extra"), F.lit(1.0).alias("kind")))
    weights = parts[0]
    for part in parts[1:]:
        weights = weights.unionByName(part)
    merged = weights.groupBy("key").agg(
        F.max("kind").cast("int").alias("kind"), F.max("n").alias("n"), F.sum("base").alias("base"), F.sum("extra").alias("extra")
    )
    return Tree(seed, growth.depth, total, distinct, durable(merged))


# -- scoring -------------------------------------------------------------------


def _threshold(weights: DataFrame, head: int) -> int:
    """The least power of two such that at most ``head`` weights occur that often."""
    by_size = {r.b: r.k for r in weights.groupBy(F.expr("cast(floor(log2(n)) AS int)").alias("b")).agg(F.count("*").alias("k")).collect()}
    held, bits = 0, max(by_size, default=0) + 1
    while bits > 0 and held + by_size.get(bits - 1, 0) <= head:
        bits -= 1
        held += by_size.get(bits, 0)
    return 1 << bits


def score(docs: DataFrame, tree: Tree, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``."""
    unknown = math.log10(EXTRA / (tree.train_tokens + EXTRA * (tree.train_symbols + 1)))
    weights = tree.weights
    often = F.col("n") >= _threshold(weights, head)
    table = weights.filter(often).select("key", "base", "extra").toArrow()  # at most ``head`` rows
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    columns = [keys[order], *(table.column(c).to_numpy()[order] for c in ("base", "extra"))]
    rare = weights.filter(~often)
    singles, longer = slots(rare.filter("kind = 1"), "key"), slots(weights.filter("kind = 0 OR extra <> 0"), "key")
    spread = docs.sparkSession.sparkContext.broadcast((columns, singles.lanes, longer.lanes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seed, depth = tree.seed, tree.depth
    fields = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known double, base double, extra double, key long, times int"
    names = [f.strip().split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed)
        (keys, bases, extras), single, more = spread.value
        lookup, single, more = Lookup(keys), Slots(single), Slots(more)
        next_row = TaskContext.get().partitionId() << 33
        for held, texts in _chunks(batches, 2, min(READ, CHUNK)):
            found, per_text = hasher.symbols(texts)
            n = len(texts)
            text = np.repeat(np.arange(n, dtype=np.int32), per_text)
            sums = np.zeros((3, n))
            sums[1] = per_text * unknown
            open_texts, open_keys = [], []
            for size, (key, inside) in enumerate(keys_before(found, per_text, depth + 1), 1):
                at = np.arange(len(key)) if size == 1 else np.flatnonzero(inside & more.has(key))
                asked = key[at]
                where = lookup.find(asked)
                hit = where >= 0
                to, which = text[at[hit]], where[hit]
                if size == 1:
                    # only single symbols have a base, and none of theirs is zero
                    sums[0] += np.bincount(to, bases[which] != 0, n)
                    sums[1] += np.bincount(to, bases[which], n)
                sums[2] += np.bincount(to, extras[which], n)
                missed = at[~hit]
                if size == 1:
                    missed = missed[single.has(key[missed])]
                open_texts.append(text[missed])
                open_keys.append(key[missed])
            to, rest = np.concatenate(open_texts), np.concatenate(open_keys)
            order = np.lexsort((rest, to))
            to, rest = to[order], rest[order]
            new = np.ones(len(to), bool)
            new[1:] = (to[1:] != to[:-1]) | (rest[1:] != rest[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(starts, append=len(to)).astype(np.int32)
            to, rest = to[starts], rest[starts]
            rows = np.arange(next_row, next_row + n)
            ids, out = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            # a row per document, dealt by any key, then one per sequence to be looked up
            whole = [pa.array(rows), ids, out, pa.array(per_text), *(pa.array(x) for x in sums)]
            yield pa.RecordBatch.from_arrays([*whole, _signed(_mix(rows.astype(np.uint64))), pa.nulls(n, pa.int32())], names=names)
            for low in range(0, len(to), 1 << 18):
                part = slice(low, low + (1 << 18))
                size = len(to[part])
                blank = [pa.nulls(size, c.type) for c in whole[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[to[part]]), *blank, _signed(rest[part]), pa.array(times[part])], names=names)
            next_row += n

    # each key looked up here is rare in training, so none of them is hot
    late = rare.select(F.col("key"), F.col("kind").alias("k"), F.col("base").alias("b"), F.col("extra").alias("x"))
    scored = (
        docs.select("doc_id", "held_out", "text").mapInArrow(run, fields)
        .join(late, "key", "left")
        .groupBy("row")
        .agg(
            *(F.max(c).alias(c) for c in ("held_out", "n_tokens")),
            F.max("doc_id").alias("doc_id"),
            *(
                (F.max(own) + F.coalesce(F.sum(F.expr(f"times * {then}")), F.lit(0.0))).alias(own)
                for own, then in (("known", "k"), ("base", "b"), ("extra", "x"))
            ),
        )
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.round("known").cast("long").alias("n_known"),
        F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + F.col("extra")).alias("score"),
    )


def prepared(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, held_out``: a tenth of the documents, by the checksum of the id, is held out."""
    kept = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return kept.withColumn("held_out", F.crc32(id_text.cast("binary")) % 10 == 0)


def lm_scores(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", growth: Growth = Growth(), head: int = HEAD
) -> DataFrame:
    """Grow the tree from the documents that are not held out and score all of them."""
    docs = prepared(df, doc_id, text)
    return score(docs, grow(docs, growth), head)
