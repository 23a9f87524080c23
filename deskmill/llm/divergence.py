"""Source divergence audit: how far the vocabulary of each source is from the others'.

Identical texts of a language collapse into one row with its multiplicity per source, are
tokenised once, and count with their weights. Terms in at least ``MIN_DOCS`` documents of
a language are kept; a group (language and source) gives each a smoothed share in
billionths, ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``. All arithmetic is exact.

The collapse moves only texts that repeat: a fixed bitmap of hash slots that occur more
than once tells them from texts that cannot, which are tokenised where they are read.
Pairs of sources are compared sparsely. A group gives all terms it lacks one share ``p0``,
so with ``d = |p0_a - p0_b|`` the distance is ::

    V d + (g_a(p0_b) - |A| d) + (g_b(p0_a) - |B| d)
        + sum over shared terms of (|p_a - p_b| - |p_a - p0_b| - |p0_a - p_b| + d)

where ``g_a(x)`` is the sum of ``|p_a - x|`` over the terms that ``a`` has, read off the
running sums over the distinct shares of ``a``. Only shared terms are joined.

Null text, language and source are the empty string; every row is a document, repeated
ones too. Groups without terms take part; where a language keeps no term, all values are
0. Equal values rank by the item's bytes. An empty table gives no rows; columns besides
the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.session import durable

MIN_DOCS = 30
TOP_TERMS = 50

# Slots of the bitmap of repeated texts: at most 2^20 lanes of 64 bits, however many texts.
SLOTS = 1 << 26
# Bytes of text that a task counts at a time.
CHUNK = 12 << 20

_COUNTS = "lang string, term string, df long, sources array<string>, counts array<long>"

# Bytes that may stand in a term: ASCII letters, and all of any other script.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``numbers, terms, text``: the number of each term in turn, the distinct terms, and whose it is."""
    data = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    solid = data != 32
    edges = np.diff(solid.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[solid].tobytes())]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    borders = np.cumsum([len(t) + 1 for t in texts])
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(borders, starts, "right")


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by ``keys``, the first one foremost, and where new ones start in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values


def _weighed(langs: list[str], sources: list[list[dict]], texts: list[bytes]) -> pa.RecordBatch | None:
    """The counts of some texts, a row per language and term."""
    numbers, terms, text = terms_of(texts)
    if not len(numbers):
        return None
    order, starts = _runs(text, numbers)
    text, numbers = text[order][starts], numbers[order][starts]
    tf = np.diff(starts, append=len(order))

    names: dict[str, int] = {}
    own = np.cumsum([0, *map(len, sources)])
    source = np.array([names.setdefault(s["source"], len(names)) for per in sources for s in per], np.int32)
    times = np.array([s["n"] for per in sources for s in per], np.int64)
    tongues: dict[str, int] = {}
    lang = np.array([tongues.setdefault(x, len(tongues)) for x in langs], np.int32)

    # every count once per source of its text
    per = np.diff(own)[text]
    back = np.repeat(np.arange(len(text)), per)
    which = own[text][back] + np.arange(len(back)) - np.repeat(np.cumsum(per) - per, per)
    of = (lang[text][back], numbers[back], source[which])
    order, starts = _runs(*of)
    of = [key[order][starts] for key in of]
    counts = _sums((tf[back] * times[which])[order], starts)
    df = _sums(times[which][order], starts)
    new = np.ones(len(starts), bool)
    new[1:] = (of[0][1:] != of[0][:-1]) | (of[1][1:] != of[1][:-1])
    rows = np.flatnonzero(new)
    offsets = pa.array(np.append(rows, len(starts)).astype(np.int32))

    def named(labels: dict[str, int], at: np.ndarray) -> pa.Array:
        return pa.array(list(labels), pa.string()).take(pa.array(at))

    return pa.RecordBatch.from_arrays(
        [
            named(tongues, of[0][rows]),
            terms.take(pa.array(of[1][rows])).cast(pa.binary()).cast(pa.string()),
            pa.array(_sums(df, rows)),
            pa.ListArray.from_arrays(offsets, named(names, of[2])),
            pa.ListArray.from_arrays(offsets, pa.array(counts)),
        ],
        names=["lang", "term", "df", "sources", "counts"],
    )


def _counted(texts: DataFrame) -> DataFrame:
    """Partial counts of ``(lang, sources, text)`` rows, one row per term and chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, sources, bodies, size = [], [], [], 0
        for batch in batches:
            langs += batch.column(0).to_pylist()
            sources += batch.column(1).to_pylist()
            found = batch.column(2).cast(pa.binary()).to_pylist()
            bodies += found
            size += sum(map(len, found))
            if size > CHUNK:
                counted = _weighed(langs, sources, bodies)
                langs, sources, bodies, size = [], [], [], 0
                if counted:
                    yield counted
        counted = _weighed(langs, sources, bodies)
        if counted:
            yield counted

    return texts.select("lang", "sources", "text").mapInArrow(run, _COUNTS)


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, sources, text``: each distinct text of a language, with its multiplicities.

    A text whose slot no other text of the table shares is alone and stays in place. The
    others meet by SHA-256, reduced within each task first, so that a text with a third
    of all rows arrives once per task and source.
    """
    slot = f"pmod(xxhash64(lang, text), {SLOTS}L)"
    lanes = durable(
        docs.selectExpr(f"{slot} AS slot")
        .groupBy("slot")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy(F.expr("slot div 64").alias("lane"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
    )
    # at most SLOTS / 64 rows of two longs: safe to broadcast at any table size
    marked = docs.withColumn("_slot", F.expr(slot)).join(F.broadcast(lanes), F.expr("_slot div 64 = lane"), "left")
    repeats = F.expr("coalesce(getbit(bits, cast(_slot % 64 AS int)), 0) = 1")
    alone = marked.filter(~repeats).select(
        "lang", F.expr("array(named_struct('source', source, 'n', 1L))").alias("sources"), "text"
    )
    once = (
        marked.filter(repeats)
        .groupBy("lang", F.sha2("text", 256).alias("digest"), "source")
        .agg(F.count("*").alias("n"), F.first("text").alias("text"))
        .groupBy("lang", "digest")
        .agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.first("text").alias("text"))
    )
    return alone.unionByName(once.select("lang", "sources", "text"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n`` of the terms in at least ``min_docs`` documents of the lang.

    One shuffle, by language and term: counts and document frequencies meet in it.
    """
    dealt = _counted(collapsed(docs)).repartition("lang", "term")
    # a partial row has its document frequency with its first source
    entries = dealt.select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")))
    entries = entries.select(
        "lang", "term", F.col("col.sources").alias("source"), F.col("col.counts").alias("n"),
        F.when(F.col("pos") == 0, F.col("df")).otherwise(0).alias("df"),
    )
    summed = entries.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    everywhere = F.sum("df").over(Window.partitionBy("lang", "term"))
    return (
        summed.withColumn("df", everywhere)
        .filter(F.col("df") >= min_docs)
        .select("lang", "source", "term", "n")
    )


def share(count: str, total: str, kept: str) -> str:
    """SQL for ``1 + floor(10^9 (count + 5) / (total + 5 kept))``, exact beyond 64 bits."""
    over = f"cast(1000000000 AS decimal(10,0)) * cast({count} + 5 AS decimal(20,0))"
    return f"1L + cast(({over}) div cast({total} + 5 * {kept} AS decimal(20,0)) AS bigint)"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` lists all other sources of
    the language by distance, part ``term`` the terms a group overuses, the first
    ``top_terms`` of them."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = durable(term_counts(docs, min_docs))
    in_lang = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang")))
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = durable(
        docs.select("lang", "source").distinct()
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "held", "v", "total_lang"])
        .withColumn("p0", F.expr(f"CASE WHEN v > 0 THEN {share('0L', 'total', 'v')} ELSE 0L END"))
    )
    shares = durable(
        counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n", "total", "v"))).select(
            "lang", "source", "term", "p", "p0", "v", "total_lang"
        )
    )
    return _pairs(groups, shares).unionByName(_terms(shares, in_lang, top_terms))


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _terms(shares: DataFrame, in_lang: DataFrame, top_terms: int) -> DataFrame:
    found = (
        shares.join(in_lang, ["lang", "term"])
        .withColumn("value", F.expr(f"p - ({share('n_lang', 'total_lang', 'v')})"))
        .filter("value > 0")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    )
    return found.withColumn("rank", _ranked(found)).filter(F.col("rank") <= top_terms)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("held_b"))
    pairs = groups.select("lang", "source", "p0", "held", "v").join(other, "lang").filter("source <> item")

    # sum over a's terms of |p_a - q0|: a's shares and the points asked about, in one order
    steps = shares.groupBy("lang", "source", F.col("p").alias("x")).agg(F.count("*").alias("k"))
    asked = pairs.select("lang", "source", F.col("q0").alias("x"), F.lit(0).cast("long").alias("k"), "item")
    line = steps.withColumn("item", F.lit(None).cast("string")).unionByName(asked)
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    apart = (
        line.withColumns(
            {
                "_below": F.sum("k").over(upto),
                "_sum_below": F.sum(F.expr("k * x")).over(upto),
                "_all": F.sum("k").over(whole),
                "_sum": F.sum(F.expr("k * x")).over(whole),
            }
        )
        .filter("k = 0")
        .select("lang", "source", "item", F.expr("_sum - 2 * _sum_below + x * (2 * _below - _all)").alias("g"))
    )

    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    excess = "abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)"
    met = (
        a.join(b, ["lang", "term"])
        .filter("source < item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(F.expr(excess)).alias("shared"))
    )
    both = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shared"))

    back = apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("g").alias("g_back"))
    key = ["lang", "source", "item"]
    valued = (
        pairs.join(apart, key).join(back, key).join(both, key, "left")
        .withColumn("value", F.expr("(v - held - held_b) * abs(p0 - q0) + g + g_back + coalesce(shared, 0L)"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    return valued.withColumn("rank", _ranked(valued))


#: The same rows in SQL, for ``documents`` as a view.
ORACLE_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(text, '') AS text
    FROM documents
), tokens AS (
    SELECT i, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM d
), kept AS (
    SELECT lang, term, count(*) AS n_lang FROM tokens GROUP BY ALL HAVING count(DISTINCT i) >= {MIN_DOCS}
), langs AS (
    SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
    SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (l.total_lang + 5 * l.v) AS q
    FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) JOIN langs l USING (lang)
        LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM d) a
        JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
            FROM grid x JOIN grid y USING (lang, term) GROUP BY ALL) f
            ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), parts AS (
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
