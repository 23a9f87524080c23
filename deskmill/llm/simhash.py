"""SimHash near duplicates, compared on bit planes.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Equal
fingerprints are one vertex. To find those at most ``radius`` bits apart, the bits
are cut into ``2 * radius`` bands (at least two): at most ``radius`` bands can differ, so two
near fingerprints agree on one of the combinations of the remaining bands, which
serve as block keys. Inside a block the fingerprints lie bit-sliced, one plane of
lanes per bit. A fingerprint meets all lanes at once: the planes that differ are
added up in carry-save counters, and the block is abandoned once every lane is
beyond the radius. Each block yields a spanning forest of its links, not all pairs;
star contraction joins the forests into components.

Blocks beyond ``BLOCK`` fingerprints are cut into chunks, and each pair of chunks is
a task of its own, so that no task holds a whole hot block and no link is lost.

Null and empty texts have fingerprint zero and link like any other. Repeated rows
have equal fingerprints. An empty table gives an empty result. A null id is carried
along, and is a component's id only where all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import fresh, map_text, with_row_key
from deskmill.llm.components import components
from deskmill.session import durable

BITS = 64
SEED = 42
# Fingerprints that one task compares with one another at once.
BLOCK = 4096
# Shingle hashes whose bits are spread out at once.
SPREAD = 65_536


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; no words give zero."""
    words = text.lower().split()  # both touch ASCII only
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SPREAD):
        part = hashes[at : at + SPREAD].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(
    df: DataFrame, text: str = "text", name: str = "fingerprint", words_per_shingle: int = 3
) -> DataFrame:
    """``df`` with the fingerprint (signed long) of every text as column ``name``."""

    def make():
        return lambda texts: [[fingerprint(t, words_per_shingle) for t in texts]]

    return map_text(df, text, f"`{name}` long", make, as_bytes=True)


def as_hex(value: Column) -> Column:
    """Sixteen lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# -- blocks ------------------------------------------------------------------


def band_masks(radius: int) -> list[int]:
    """Bit masks, one of which covers no differing bit of any pair within ``radius``."""
    bands = max(2, 2 * radius)
    cuts = [round(BITS * i / bands) for i in range(bands + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, bands - radius)]


def block_keys(value: Column, radius: int) -> Column:
    """The block keys of a fingerprint: a hash of band combination and its bits."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in band_masks(radius)]
    return F.array(
        *(F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed))
    )


class BitPlanes:
    """Fingerprints of one block, stored one plane of lanes per bit."""

    def __init__(self, values: np.ndarray):
        self.lanes = len(values)
        self.full = (1 << self.lanes) - 1
        bits = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = [int.from_bytes(p.tobytes(), "little") for p in packed]

    def near(self, value: int, radius: int, lanes: int) -> int:
        """Those of ``lanes`` (a bit mask) at most ``radius`` bits from ``value``.

        Counters hold the distances in carry-save form: digit ``k`` of every lane's
        count is bit ``lane`` of ``digits[k]``. ``over`` collects the lanes whose
        count has passed the radius.
        """
        width = (radius + 1).bit_length()
        digits = [0] * width
        over = ~lanes & self.full
        limit = radius + 1
        for b, plane in enumerate(self.planes):
            carry = plane ^ self.full if value >> b & 1 else plane
            carry &= ~over
            if not carry:
                continue
            for k in range(width):
                digits[k], carry = digits[k] ^ carry, digits[k] & carry
                if not carry:
                    break
            reached = self.full
            for k in range(width):
                reached &= digits[k] if limit >> k & 1 else ~digits[k]
            over |= reached
            if over == self.full:
                return 0
        return self.full & ~over


def block_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block of distinct fingerprints."""
    planes = BitPlanes(values)
    plain = values.tolist()
    root = list(range(len(plain)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, value in enumerate(plain[:-1]):
        found = planes.near(value, radius, planes.full >> (i + 1) << (i + 1))
        while found:
            low = found & -found
            found ^= low
            j = low.bit_length() - 1
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((value, plain[j]))
    return links


def near_links(distinct: DataFrame, value: str, radius: int) -> DataFrame:
    """``(a, b)``: links that connect whatever lies within ``radius`` of one another."""
    posts = distinct.select(
        F.col(value).alias("fp"), F.explode(block_keys(F.col(value), radius)).alias("block")
    )
    sizes = posts.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1")
    chunked = (
        posts.join(sizes, "block")
        .withColumn("c", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select(
            "fp",
            F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(tasks: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(tasks)) + 1
            links: list[tuple[int, int]] = []
            for part in np.split(values, cuts):
                if len(part) > 1:
                    links += block_forest(part, radius)
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

        tasks = values = np.empty(0, np.int64)
        for batch in batches:
            tasks = np.concatenate([tasks, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy()])
            if not len(tasks):
                continue
            done = int(np.searchsorted(tasks, tasks[-1]))  # the last block may go on
            if done:
                yield emit(tasks[:done], values[:done])
                tasks, values = tasks[done:], values[done:]
        if len(tasks):
            yield emit(tasks, values)

    return (
        chunked.repartition("task")
        .select("task", "fp")
        .sortWithinPartitions("task", "fp")
        .mapInArrow(compare, "a long, b long")
    )


# -- components --------------------------------------------------------------


def simhash_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words_per_shingle: int = 3
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row; the component's id is the
    smallest id reachable over links of at most ``radius`` differing bits."""
    prints = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints, rooted = _rooted(prints, radius, words_per_shingle)
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def _rooted(docs: DataFrame, radius: int, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``doc_id``, ``text`` and more) with ``fp`` for its text, as a written table, and
    ``(fp, first_id, component)``: the component of every fingerprint."""
    printed = with_fingerprint(docs, "text", "fp", words_per_shingle)
    prints = durable(printed.drop("text"))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = durable(near_links(distinct, "fp", radius))
    member = components(links, "a", "b").withColumnRenamed("vertex", "fp")
    rooted = distinct.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return prints, rooted


def one_of_each(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words_per_shingle: int = 3
) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the document with
    the smallest id stays, one without an id only where none has one. Decided per
    document: of different texts with one id, each goes by its own component. Of
    repeated rows of a document one stays."""
    row, key, part = fresh(df, "_row", "_kept_id", "_kept_row")
    keyed = with_row_key(df, doc_id, text, row)
    docs = keyed.select(F.col(doc_id).alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    prints, rooted = _rooted(docs, radius, words_per_shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = durable(prints.join(rooted.select("fp", "component"), "fp").groupBy("component").agg(first.alias("f")))
    chosen = keep.select(F.col("f.doc_id").alias(key), F.col("f.row").alias(part))
    same = F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(row) == F.col(part))
    kept = keyed.join(chosen, same, "left_semi")
    repeated = prints.join(chosen, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col("row") == F.col(part)), "left_semi")
    if not repeated.groupBy("doc_id", "row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, row])
    return kept.drop(row)
