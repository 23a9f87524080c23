"""Document fingerprints by spot signatures.

Common words are anchors. The chain of content words that follows an anchor is a spot
signature; a document's fingerprint is its set of signatures. Navigation and lists have
few common words and so hardly count. The likeness of two documents is the Jaccard
similarity of their sets.

:func:`near_duplicates` compares a whole table: sets are partitioned by their length, so
that only lengths whose ratio allows the similarity meet, and inside a partition only
sets that share a signature of their prefix; the rest is pruned by length and position
before the exact Jaccard is taken.

Null texts are empty. A text without any signature has its whole word sequence as its
one signature, so that equal texts always have equal fingerprints, and only equal ones
of that kind are alike. Equal ids are ordered by text, null ids come last. An empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import map_text, text_or_empty
from deskmill.session import durable

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in a is that for it with as was on be by at this are or from his have an they which"
    " der die das und von den des mit sich auf für ist im dem nicht ein eine als auch es an er hat aus"
    " le la les et un une du pour que qui dans par sur pas plus au avec ce il sont"
    " el los las y en que por con del se no su para como más pero lo al sus".split()
)
# Content words of a chain.
CHAIN = 2
# Documents per range of ids that one task walks through, on average, and ranges at most.
RANGE_DOCS = 4_000
MAX_RANGES = 20_000

_WORD = re.compile(r"\w+")


def signatures(text: str) -> set[int]:
    """The spot signatures of a text, as 32-bit hashes."""
    words = _WORD.findall(text.lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for word in words:
        if word in ANCHORS:
            spots.append((word, len(content)))
        else:
            content.append(word)
    digest = xxhash.xxh32_intdigest
    last = len(content) - CHAIN
    found = {digest(" ".join((a, *content[k : k + CHAIN]))) for a, k in spots if k <= last}
    return found or {digest(" ".join(words))}


def write_out(found: set[int]) -> str:
    """A fingerprint: eight hex digits per signature, in order."""
    return "".join(f"{s:08x}" for s in sorted(found))


def read_back(fingerprint: str) -> set[str]:
    return {fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)}


def likeness(a: set, b: set, least: float = 0.0) -> float:
    """Jaccard similarity, or 0 as soon as the set sizes show that it is below ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


# -- edited texts and neighbours -----------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with ``range``: falling ids fall into rising ranges, nulls into the last."""
    n, lowest, highest = docs.agg(F.count("id"), F.min("id"), F.max("id")).first()
    ranges = int(min(MAX_RANGES, max(1, n // RANGE_DOCS)))
    cuts: list[float] = []
    if ranges > 1:
        shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        found = docs.agg(F.percentile_approx("id", shares, max(10_000, 10 * ranges))).first()[0]
        cuts = sorted({float(v) for v in found if lowest < v < highest})
    if not cuts:
        return docs.withColumn("range", F.when(F.col("id").isNull(), 2).otherwise(1)), 2
    splits = [-math.inf, *cuts, math.inf]
    bucket = Bucketizer(splits=splits, inputCol="at_", outputCol="range_", handleInvalid="keep")
    last = len(splits)
    placed = bucket.transform(docs.withColumn("at_", F.col("id").cast("double")))
    number = F.when(F.col("id").isNull(), last).otherwise(len(splits) - 1 - F.col("range_")).cast("int")
    return placed.withColumn("range", number).drop("at_", "range_"), last


def with_next(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows ``(range, guest, id, text)`` in tasks by range, falling ids: a text is followed by
    the next one, at the end of a range by a ``guest``, the first text of the next range."""
    docs = df.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    placed, _ = _ranges(docs)
    heads = durable(placed.groupBy("range").agg(F.max("id").alias("head")))
    order = [r.range for r in heads.select("range").orderBy("range").collect()]
    if not order:
        return placed.select("range", F.lit(0).alias("guest"), "id", "text")
    # The range before, around the end: one row per range, so at most MAX_RANGES.
    before = F.element_at(
        F.create_map(*(F.lit(x) for pair in zip(order, [order[-1], *order[:-1]]) for x in pair)), F.col("range")
    )
    first = (
        placed.join(F.broadcast(heads), "range")
        .filter("id <=> head")
        .groupBy("range", "id")
        .agg(F.min("text").alias("text"))
    )
    guests = durable(first.select(before.alias("range"), F.lit(1).alias("guest"), "id", "text"))
    own = placed.select("range", F.lit(0).alias("guest"), "id", "text")
    return (
        own.unionByName(guests)
        .repartition("range")
        .sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), "text")
    )


def edit_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and the likeness of its own to
    that and to the next document's."""
    kind = df.schema[doc_id].dataType.simpleString()
    rest = (
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    schema = f"doc_id {kind}, {rest}"
    names = ["doc_id", *(f.split()[0] for f in rest.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # (range, guest, id, text, signatures)
        rows: list[tuple] = []
        size = 0

        def flush(id_type) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )
            rows.clear()
            return out

        for batch in batches:
            id_type = batch.column(2).type
            for now in zip(*(c.to_pylist() for c in batch.columns)):
                now = (*now, signatures(now[3]))
                if pending is not None and pending[0] == now[0] and not pending[1]:
                    _, _, key, own_text, own = pending
                    new_text = edited(own_text, now[3])
                    new = signatures(new_text)
                    rows.append(
                        (
                            key,
                            len(own_text),
                            hashlib.sha256(new_text.encode()).hexdigest(),
                            write_out(own),
                            write_out(new),
                            likeness(own, new),
                            likeness(own, now[4]),
                        )
                    )
                    size += len(own) + len(new)
                    if size > 200_000:
                        yield flush(id_type)
                        size = 0
                pending = now
        if rows:
            yield flush(id_type)

    return with_next(df, doc_id, text).mapInArrow(run, schema)


# -- comparison of a whole table -----------------------------------------------


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, class)`` of every document, and ``(a, b, likeness)`` of pairs of classes.

    A class is all documents with one fingerprint, named by its hash.
    """

    def make():
        return lambda texts: [[sorted(signatures(t)) for t in texts]]

    printed = map_text(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t_")), "t_", "sigs array<long>", make)
    printed = durable(printed.select("doc_id", F.xxhash64("sigs").alias("class"), "sigs"))
    sets = printed.groupBy("class").agg(F.min("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    prefix = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1
    part = F.floor(F.log("n") / math.log(1 / least) + 1e-9).cast("int")
    home = sets.select("class", "n", part.alias("part"), F.posexplode(F.slice("sigs", F.lit(1), prefix)).alias("p", "sig"))
    # A set meets those of its own partition and of the one above.
    guest = home.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    x, y = home.alias("x"), guest.alias("y")

    def bound(s: str) -> Column:
        return F.col(f"{s}.n") - F.col(f"{s}.p")

    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * least / (1 + least) - 1e-9)
    pairs = (
        x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.sig") == F.col("y.sig")))
        .filter((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class"))))
        .filter((small >= large * least - 1e-9) & (F.least(bound("x"), bound("y")) >= needed))
        .select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        .distinct()
    )
    a = sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common / (F.size("sa") + F.size("sb") - common)
    links = pairs.join(a, "a").join(b, "b").select("a", "b", alike.alias("likeness"))
    return printed.select("doc_id", "class"), links.filter(F.col("likeness") >= least - 1e-12)
