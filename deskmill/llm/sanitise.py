"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

*Base spans* are e-mail addresses, IP addresses, card and phone numbers, found by
pattern and checked by range, Luhn digit and length. Their distinct values are the
protected entities.

*Terms* are the words of a text outside its base spans, of any length and in any script,
without the marks around them. How strongly a term reveals an entity is
estimated from the corpus: of the documents that hold the term, the share that holds
the entity, ``P(e|t)``, and the information gained, ``log2 P(e|t) / P(e)``. A term may stand
anywhere in the text. Copies are one context: a term counts only if it was
seen with the entity in documents that show the entity in several different surroundings
(the characters next to it; of several in one document the one with the least hash). Terms beyond the
thresholds are removed wherever they occur if they all but name the entity, or else
generalised to the kind of what they reveal.

All counts are over all documents, by partial aggregation. Pairs of term and entity are
only formed where they can still pass, by bounds that lose none: the entity has enough surroundings
and is rare enough for the bits asked for; the term is in enough documents, and, of the
documents of such entities alone, in no more than the entity's number allows. Whatever is
joined is joined by hash; a side is broadcast only below a measured size.

Positions are running sums over whole arrays, and texts are cut by way of blocks, so a text
of hundreds of thousands of matches takes near-linear time.

Null texts are empty. Rows with one id and one text are one document; different texts of
one id, and rows without an id, are documents of their own. Each row is sanitised for itself. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import text_or_empty, with_row_key
from deskmill.session import durable

# The kinds of personal data, in their order, and their patterns.
# Possessive where giving back characters could not lead to a match.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character or digit without which a kind cannot match: spares most texts the search.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "term"


@dataclass(frozen=True)
class Thresholds:
    """When a term discloses an entity."""

    surrounding_chars: int = 60  # tells copies apart; terms stand anywhere
    min_contexts: int = 3
    min_share: float = 0.5
    min_bits: float = 4.0
    remove_share: float = 0.9


# Rows of disclosing terms up to which they are broadcast.
BROADCAST_ROWS = 100_000
_BLANKS = r"[\x20\x09-\x0D]+"
# Code points of the blocks that texts are cut by.
BLOCK = 1024


# -- arrays and texts in linear steps --------------------------------------------


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Entry ``i`` of the result combines the entries 0 to ``i`` (0 or more) of an array.

    Each round combines every entry with the one ``2^k`` places before it.
    """

    def doubled(v: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            shift = F.call_function("shiftleft", F.lit(1), k)
            earlier = F.concat(F.array_repeat(F.lit(0), shift), F.slice(a, F.lit(1), F.size(a) - shift))
            return F.zip_with(a, earlier, combine)

        rounds = F.ceil(F.log2(F.size(v).cast("double"))).cast("int")
        return F.when(F.size(v) > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), v, step)).otherwise(v)

    return _let(values, doubled)


def _sums(values: Column) -> Column:
    return _running(values, lambda x, y: x + y)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, or to the last one, of a text given in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")

    def part(b: Column) -> Column:
        at = F.greatest(start - b * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, b), at + 1, F.least(end - b * BLOCK, F.lit(BLOCK)) - at)

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def _merged(spans: Column) -> Column:
    """Sorted ``(start, end, put)`` without overlaps: spans that overlap become one, with the
    first one's ``put``."""

    def merge(all_: Column) -> Column:
        def islands(reach: Column) -> Column:
            heads = F.filter(
                F.transform(all_, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull()
            )
            return _let(
                heads,
                lambda hs: F.transform(
                    hs,
                    lambda h, j: F.struct(
                        F.get(all_, h)["start"].alias("start"),
                        F.get(reach, F.coalesce(F.get(hs, j + 1), F.size(all_)) - 1).alias("end"),
                        F.get(all_, h)["put"].alias("put"),
                    ),
                ),
            )

        return _let(_running(F.transform(all_, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), islands)

    return _let(spans, merge)


def _rewritten(text: Column, spans: Column) -> Column:
    """``text`` with what the sorted, disjoint ``(start, end, put)`` cover put anew."""

    def write(blocks: Column, all_: Column) -> Column:
        ended = lambda i: F.coalesce(F.get(all_, i)["end"], F.lit(0))
        pieces = F.flatten(F.transform(all_, lambda x, i: F.array(_cut(blocks, ended(i - 1), x["start"]), x["put"])))
        rest = _cut(blocks, ended(F.size(all_) - 1), F.char_length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), "")

    whole = _let(_blocks(text), lambda blocks: _let(spans, lambda all_: write(blocks, all_)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


# -- base spans ----------------------------------------------------------------


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    weights = F.sequence(F.lit(1), F.char_length(digits))

    def weighed(i: Column) -> Column:
        digit = digits.substr(i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when((F.char_length(digits) - i) % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.transform(weights, weighed), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        small = lambda p: (F.char_length(short(p)) <= 3) & (F.right(short(p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, "\\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "card":
        return n.between(14, 19) & _luhn(F.left(digits, F.lit(19)))
    return n.between(10, 15)


def _spans_of(kind: str, text: Column) -> Column:
    """Array of ``(start, end, value)`` of the valid matches of a kind, in code points.

    The gaps between matches are what splitting by the same pattern leaves; the first
    ``i + 1`` gaps and ``i`` matches add up to the start of match ``i``.
    """
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.char_length)

    def placed(matches: Column) -> Column:
        taken = F.concat(F.array(F.lit(0)), F.transform(matches, F.char_length))
        starts = _sums(F.zip_with(gaps, taken, lambda g, m: g + m))
        return F.zip_with(
            matches,
            starts,
            lambda m, s: F.when(
                m.isNotNull(), F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("value"))
            ),
        )

    found = _let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), placed)
    valid = F.filter(found, lambda x: x.isNotNull() & _valid(kind, x["value"]))
    need = NEEDS[kind]
    possible = F.contains(text, F.lit(need)) if need else text.rlike("[0-9][ -]?[0-9]")
    return F.when(possible, valid)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``doc``: its key) with ``base``: an array of ``(start, rank, end, kind, value)``."""
    # One column per kind, each in a projection of its own, so that a kind is searched once.
    found = docs
    for kind in KINDS:
        found = found.withColumn(f"s_{kind}", _spans_of(kind, F.col("text")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def labelled(rank: int, kind: str) -> Column:
        one = F.transform(
            F.col(f"s_{kind}"),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                F.lit(kind).alias("kind"), x["value"].alias("value"),
            ),
        )
        return F.coalesce(one, empty)

    base = F.array_sort(F.concat(*(labelled(i, k) for i, k in enumerate(KINDS))))
    return found.withColumn("base", base).drop(*(f"s_{k}" for k in KINDS))


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


# -- disclosing terms --------------------------------------------------------------

_LEADING = r"^[^\p{L}\p{N}]+"
_TRAILING = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _term(word: Column) -> Column:
    """A word without the marks around it, in lower case."""
    return F.lower(F.regexp_replace(word, f"{_LEADING}|{_TRAILING}", ""))


def _bare() -> Column:
    """``text`` with blanks in place of its base spans; all else stands where it stood."""
    blank = F.transform(
        "base",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("put")),
    )
    same_length = F.transform(
        _merged(blank),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(s["put"], s["end"] - s["start"]).alias("put")),
    )
    return F.when(F.size("base") == 0, F.col("text")).otherwise(_rewritten(F.col("text"), same_length))


def _words(docs: DataFrame) -> DataFrame:
    """``(doc, term)``: the distinct terms of every document."""
    terms = F.array_distinct(F.transform(F.split(_bare(), _BLANKS), _term))
    return docs.select("doc", F.explode(terms).alias("term")).filter("term <> ''")


def _mentions(spotted: DataFrame, limits: Thresholds) -> DataFrame:
    """``(doc, entity, kind, context)``: the entities of every document, each with a hash of
    what stands around it."""
    w = limits.surrounding_chars
    seen = _let(
        _blocks(F.col("text")),
        lambda blocks: F.transform(
            "base",
            lambda s: F.struct(
                F.xxhash64(F.lower(s["value"])).alias("entity"),
                s["kind"].alias("kind"),
                F.xxhash64(
                    _cut(blocks, F.greatest(s["start"] - w, F.lit(0)), s["start"]),
                    _cut(blocks, s["end"], s["end"] + w),
                ).alias("context"),
            ),
        ),
    )
    each = spotted.filter(F.size("base") > 0).select("doc", F.inline(seen))
    return each.groupBy("doc", "entity", "kind").agg(F.min("context").alias("context"))


def _bounded(rows: DataFrame) -> DataFrame:
    """``rows``, marked for a broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def disclosing_terms(spotted: DataFrame, limits: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame] | None:
    """``(term, kind, share, bits)`` of the terms that reveal some entity too well, and
    ``(doc, term)`` of the documents that hold them; None if there are none."""
    total = float(spotted.count())
    seen = durable(_mentions(spotted, limits))
    entities = seen.groupBy("entity", "kind").agg(
        F.count("*").alias("n_entity"), F.count_distinct("context").alias("contexts")
    )
    # The share is at most 1, so an entity in too many documents can never give the bits asked for.
    most = total / 2**limits.min_bits
    entities = entities.filter((F.col("contexts") >= limits.min_contexts) & (F.col("n_entity") <= most)).drop("contexts")
    live = durable(seen.join(entities, ["entity", "kind"]))
    largest = live.agg(F.max("n_entity")).first()[0]
    if largest is None:
        return None
    holders = _bounded(durable(live.select("doc").distinct()))
    near = durable(_words(spotted.join(holders, "doc", "left_semi")))
    # A term is in at least as many documents as it is met in here. Those that fall short of
    # the share even so need no pairs and no further count: common words, above all.
    met = near.groupBy("term").agg(F.count("*").alias("n_met"))
    met = met.filter((F.col("n_met") >= limits.min_contexts) & (F.col("n_met") * limits.min_share <= largest))
    pairs = (
        near.join(met, "term")
        .join(live, "doc")
        .filter(F.col("n_met") * limits.min_share <= F.col("n_entity"))
        .groupBy("term", "entity", "kind")
        .agg(
            F.count_distinct("context").alias("contexts"),
            F.count("*").alias("n_both"),
            F.max("n_entity").alias("n_entity"),
            F.max("n_met").alias("n_met"),
        )
    )
    likely = durable(
        pairs.filter((F.col("contexts") >= limits.min_contexts) & (F.col("n_both") >= limits.min_share * F.col("n_met")))
    )
    if likely.isEmpty():
        return None
    held = durable(_words(spotted).join(_bounded(likely.select("term").distinct()), "term", "left_semi"))
    counted = held.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = (
        likely.join(counted, "term")
        .withColumn("share", F.col("n_both") / F.col("n_term"))
        .withColumn("bits", F.log2(F.col("share") * F.lit(total) / F.col("n_entity")))
        .filter((F.col("share") >= limits.min_share) & (F.col("bits") >= limits.min_bits))
    )
    # Of several entities that a term reveals, the one it reveals best.
    best = F.max(F.struct("share", "bits", "kind"))
    terms = durable(scored.groupBy("term").agg(best.alias("b")).select("term", "b.kind", "b.share", "b.bits"))
    return None if terms.isEmpty() else (terms, held)


_TERM_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,reveals:string,remove:boolean>>"


def with_spans(docs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """``(doc_id, text, base, terms)``: base spans, and the spans of disclosing terms with
    the kind they reveal and whether they are to be removed."""
    spotted = durable(with_base_spans(docs))
    found = disclosing_terms(spotted, limits)
    if found is None:
        return spotted.withColumn("terms", F.array().cast(_TERM_SPANS))
    terms, held = found
    hits = (
        held.join(_bounded(terms), "term")
        .groupBy(F.col("doc").alias("hit_doc"))
        .agg(
            F.map_from_entries(
                F.collect_set(
                    F.struct("term", F.struct("kind", (F.col("share") >= limits.remove_share).alias("remove")))
                )
            ).alias("known")
        )
    )
    joined = spotted.join(_bounded(durable(hits)), F.col("doc") == F.col("hit_doc"), "left")
    spans = F.when(F.col("known").isNull(), F.array().cast(_TERM_SPANS)).otherwise(_term_spans(F.col("known")))
    return joined.withColumn("terms", spans).drop("known", "hit_doc")


def _term_spans(known: Column) -> Column:
    """Where the words of ``text`` stand whose term is a key of ``known``."""

    def spans(pieces: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(pieces, F.char_length))
        placed = F.zip_with(
            pieces, _sums(before), lambda p, at: F.struct(at.alias("at"), p.alias("word"), _term(p).alias("term"))
        )
        hit = F.filter(placed, lambda x: x["word"].isNotNull() & F.map_contains_key(known, x["term"]))

        def span(x: Column) -> Column:
            core = F.regexp_replace(x["word"], _LEADING, "")
            start = x["at"] + F.char_length(x["word"]) - F.char_length(core)
            value = F.regexp_replace(core, _TRAILING, "")
            tells = F.try_element_at(known, x["term"])
            return F.struct(
                start.alias("start"), F.lit(len(KINDS)).alias("rank"), (start + F.char_length(value)).alias("end"),
                F.lit(TERM).alias("kind"), value.alias("value"), tells["kind"].alias("reveals"),
                tells["remove"].alias("remove"),
            )

        return F.transform(hit, span)

    return _let(F.split(_bare(), r"(?<=[\x20\x09-\x0D])|(?=[\x20\x09-\x0D])", -1), spans)


# -- results -------------------------------------------------------------------------


def sanitised(spanned: DataFrame) -> DataFrame:
    """``(doc_id, text, sanitised)``: base spans become their kind in brackets, terms their
    generalisation, or nothing where they all but name an entity. Spans that overlap become
    one, under the name of the first, of those with equal starts the longest."""
    name = lambda s, kind, tail: F.concat(F.lit("["), F.upper(s[kind]), F.lit(tail))
    put = {
        "base": lambda s: name(s, "kind", "]"),
        "terms": lambda s: F.when(s["remove"], "").otherwise(name(s, "reveals", "-RELATED]")),
    }
    unit = "array<struct<start:int,back:int,put:string>>"
    every = [
        F.transform(c, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), f(s).alias("put"))).cast(unit)
        for c, f in put.items()
    ]
    ordered = F.transform(
        F.array_sort(F.concat(*every)),
        lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["put"].alias("put")),
    )
    whole = _rewritten(F.col("text"), _merged(ordered))
    return spanned.withColumn("sanitised", whole).select("doc_id", "text", "sanitised")


def span_report(spanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans per document."""
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS
    ]
    plain = "array<struct<start:int,rank:int,end:int,kind:string>>"
    flat = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(plain)
    every = F.array_sort(F.concat(flat("base"), flat("terms")))
    return spanned.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def find_personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Thresholds = Thresholds()) -> DataFrame:
    """``(doc_id, text, base, terms)`` of every row of ``df``."""
    docs = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    keyed = with_row_key(docs, "doc_id", "text", "row")
    numbered = keyed.select("doc_id", "text", F.xxhash64("doc_id", "row").alias("doc"))
    return with_spans(numbered, limits).drop("doc")
