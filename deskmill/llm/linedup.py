"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its lower-cased words. A line goes if an earlier line (order:
document id, row key, line number) has at least ``THRESHOLD`` Jaccard similarity with it.
Only lines without a word are left aside. Up to three words, similar means equal, which
the hash of the set tells; longer lines are joined.

1. Words are counted over all documents; every line's word hashes are ordered by rarity.
   Tasks look the rarity up in a table of fixed size, two rows of ``BUCKETS`` classes: a
   bucket holds the greatest class of its words, a word has the lesser of its two buckets.
   Any fixed order keeps the join exact; this one errs only towards "frequent". A word of
   class 0 occurs once in all texts, so it needs no posting.
2. Lines with equal sets meet by hash; the earliest stands for them all.
3. Prefix filter: two similar lines share one of their rarest ``n - ceil(t n) + 1``
   words, so only those become postings. Partners must pass the length filter, the
   positional filter and a parity filter (bit parities of the word hashes differ in
   at most as many bits as the sets differ in words).
4. A line goes for one earlier match, so it leaves the search with the first that is
   verified on the words themselves. First each posting meets the earliest of its list,
   which settles groups of many near copies; then open lines meet their whole lists, and
   the partner of nearest parity is verified; then lines still open have all partners that
   pass the filters verified. No match is lost, and only the last step, where little is
   left, writes more than one pair per line.

Everything is DataFrame operations. What reaches the driver is the table of rarity
classes, whose size is fixed. Word hashes have 58 bits in the order and 64 in equal sets,
whose 128 parity bits must agree as well. Ids are whole numbers of at most 64 bits.

Null and empty texts have no lines that could go. Repeated rows with one id and one text
are the same lines, and the row itself stays. Different texts of one id are documents of
their own, in the order of a row key. A null id counts as the smallest id there is, and
each row that has it is a document of its own. An empty table stays empty; further columns
pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.common import fresh, with_row_key
from deskmill.session import brief_plans, durable

# Similar lines share at least four of five words of their union.
THRESHOLD = (4, 5)
# Words from which a line can be similar to another set than its own.
JOIN_WORDS = 4
# Buckets in each of the two rows of the table of rarity classes.
BUCKETS = 1 << 21
# Rarity classes: two per doubling of the count; 0 for words that occur once.
CLASSES = 62
# Words of a line whose lists' earliest lines are tried first.
EARLY_WORDS = 3
# Rows up to which the list of affected documents is broadcast instead of shuffled.
BROADCAST_ROWS = 300_000

# What tells a line: its document's id and row key, and its number.
LINE = ["d", "r", "ln"]

_BLANKS = "[\\x20\\x09-\\x0D]+"


def _word_hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r\x0b\x0c")), _BLANKS)


def rarity_table(df: DataFrame, text: str) -> bytes:
    """The greatest class of each bucket's words, one byte each, both rows one after the other.

    Eight buckets come to the driver as one number.
    """
    words = df.select(F.explode(F.split(F.lower(F.col(text)), _BLANKS)).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("c"))
    classed = counts.select("h", F.least(F.lit(CLASSES - 1), F.floor(F.log2("c") * 2)).cast("int").alias("k"))
    spread = classed.filter("k > 0").select(F.explode(F.array(*_buckets(F.col("h")))).alias("b"), "k")
    filled = spread.groupBy("b").agg(F.max("k").alias("k"))
    byte = F.expr("shiftleft(cast(k as bigint), 8 * (b & 7))")
    lanes = filled.groupBy(F.shiftright("b", 3).alias("lane")).agg(F.bit_or(byte).alias("bits")).toArrow()
    table = np.zeros(2 * BUCKETS // 8, "<i8")
    table[lanes["lane"].to_numpy()] = lanes["bits"].to_numpy()
    return table.tobytes()


def _buckets(h: Column) -> list[Column]:
    """A word's places in the two rows, from bits that do not overlap."""
    mask = F.lit(BUCKETS - 1)
    first, second = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)
    return [first.cast("int"), (second + F.lit(BUCKETS)).cast("int")]


def _ordered(hashes: Column, table: Column) -> Column:
    """The hashes with their rarity class on top, so that natural order puts rare ones first."""

    def key(h: Column) -> Column:
        classes = (F.ascii(F.substring(table, at + 1, 1).cast("string")) for at in _buckets(h))
        rank = F.least(*classes) - F.lit(CLASSES // 2)
        return F.shiftleft(rank.cast("long"), 58).bitwiseOR(F.shiftrightunsigned(h, 6))

    return F.sort_array(F.transform(hashes, key))


def _parity(hashes: Column, half: int) -> Column:
    """Every word has one of 128 bits; of one half of them, whether an odd number of the words has it."""

    def bit(h: Column) -> Column:
        mine = F.shiftrightunsigned(h if half else F.bitwise_not(h), 63)
        return F.call_function("shiftleft", mine, h.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))


def lines_of(df: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """``(d, r, ln, line)``: all lines, in lower case. A null id counts as the smallest there is."""
    docs = df.select(_order_id(F.col(doc_id)).alias("d"), F.col(row).alias("r"), F.col(text).alias("t"))
    return docs.select("d", "r", F.posexplode(F.split(F.lower("t"), "\n")).alias("ln", "line"))


def _order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def worded(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))


def line_sets(lines: DataFrame, table: bytes) -> DataFrame:
    """``(d, r, ln, h, n, s, u, prefix)``: every line with a word.

    ``h`` is the hash of its set, ``n`` its size, ``s`` and ``u`` are its parity bits, ``prefix`` its
    rarest words, as halves of their hashes: more would only keep apart what the filters and the verification keep
    apart anyway. Words that occur once in all texts are null there, they have no other line to find.
    """
    hashed = worded(lines).select(*LINE, F.sort_array(_word_hashes(F.col("line"))).alias("hashes"))
    n = F.size("hashes")
    rarest = F.slice(_ordered(F.col("hashes"), F.lit(bytearray(table))), F.lit(1), _prefix_length(n))
    once = -(CLASSES // 2)
    return hashed.select(
        *LINE,
        F.xxhash64("hashes").alias("h"),
        n.alias("n"),
        *(_parity(F.col("hashes"), half).alias(name) for half, name in enumerate("su")),
        F.transform(rarest, lambda k: F.when(F.shiftright(k, 58) > once, F.hash(k))).alias("prefix"),
    )


def _prefix_length(n: Column) -> Column:
    a, b = THRESHOLD
    return n - F.ceil(n * F.lit(a) / F.lit(b)).cast("int") + 1


def _distance(x: str, y: str) -> str:
    return f"(bit_count({x}s ^ {y}s) + bit_count({x}u ^ {y}u))"


def _may_match(x: str, y: str) -> Column:
    """Parity, length and positional filters for two postings of one word.

    The similar share at least ``(n1 + n2) t / (1 + t)`` words and differ in the others.
    """
    a, b = THRESHOLD
    n1, n2 = f"shiftright({x}np, 32)", f"shiftright({y}np, 32)"
    after1, after2 = (f"({n} - ({s}np & 2147483647))" for n, s in ((n1, x), (n2, y)))
    return F.expr(
        f"{a + b} * {_distance(x, y)} <= {b - a} * ({n1} + {n2})"
        f" and {b} * least({n1}, {n2}) >= {a} * greatest({n1}, {n2})"
        f" and {a + b} * least({after1}, {after2}) >= {a} * ({n1} + {n2})"
    )


def _earlier(y: str, x: str) -> Column:
    within = f"{y}r < {x}r or ({y}r = {x}r and {y}ln < {x}ln)"
    return F.expr(f"{y}d < {x}d or ({y}d = {x}d and ({within}))")


X, Y = (["xd", "xr", "xln"], ["yd", "yr", "yln"])
PAIR = [*X, *Y]
PARTS = [*LINE, "np", "s", "u"]


def postings(lines: DataFrame) -> DataFrame:
    """``(w, d, r, ln, np, s, u)``, one row per prefix word of every line.

    ``np`` holds the line's words, whether it is ``done`` (where ``lines`` tells), and the word's position.
    """
    done = "cast(done as bigint)" if "done" in lines.columns else "0L"
    spread = lines.withColumn("np", F.expr(f"shiftleft(cast(n as bigint), 32) | shiftleft({done}, 31)")).select(
        F.posexplode("prefix").alias("p", "w"), *LINE, "np", "s", "u"
    )
    return spread.filter("w is not null").select("w", *LINE, F.expr("np | p").alias("np"), "s", "u")


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("w", *(F.col(c).alias(prefix + c) for c in df.columns if c != "w"))


def against_earliest(lines: DataFrame) -> DataFrame:
    """Per line the partner of nearest parity among the earliest of the lists of its rarest words."""
    rare = F.slice(F.filter("prefix", lambda w: w.isNotNull()), 1, EARLY_WORDS)
    own = F.transform(rare, lambda w: F.struct((F.array_position("prefix", w) - 1).alias("p"), w.alias("w")))
    spread = lines.select(*LINE, "n", "s", "u", F.inline(own))
    posts = spread.select("w", *LINE, F.expr("shiftleft(cast(n as bigint), 32) | p").alias("np"), "s", "u")
    headed = posts.withColumn("f", F.first(F.struct(*PARTS)).over(Window.partitionBy("w").orderBy(*LINE)))
    both = headed.select(
        *(F.col(c).alias(f"x{c}") for c in PARTS), *(F.col(f"f.{c}").alias(f"y{c}") for c in PARTS)
    )
    return _nearest(both.filter(_earlier("y", "x") & _may_match("x", "y")))


def within_lists(lines: DataFrame, settled: DataFrame) -> DataFrame:
    """Per line that is not settled the partner of nearest parity among all earlier lines of its lists.

    Both sides of the join read one and the same shuffle. So what keeps settled lines from searching must be no
    filter of one side: their bit ``done`` is above any number of words.
    """
    known = _few(settled.withColumn("done", F.lit(True)))
    flagged = lines.join(known, LINE, "left").withColumn("done", F.coalesce("done", F.lit(False)))
    posts = postings(flagged).repartition("w")
    is_open = F.expr("xnp & 2147483648L < shiftright(ynp, 32)")
    both = _as(posts, "x").join(_as(posts, "y"), "w")
    found = both.filter(_earlier("y", "x") & _may_match("x", "y") & is_open)
    return _nearest(found)


def all_partners(lines: DataFrame, few: DataFrame) -> DataFrame:
    """All pairs of the lines ``few`` with earlier ones that pass the filters."""
    x = _few(durable(_as(postings(lines.join(_few(few), LINE, "left_semi")), "x")))
    found = x.join(_as(postings(lines), "y"), "w").filter(_earlier("y", "x") & _may_match("x", "y"))
    return found.select(*PAIR).distinct()


def _nearest(found: DataFrame) -> DataFrame:
    near = F.min(F.struct(F.expr(_distance("x", "y")).alias("apart"), *Y)).alias("y")
    return found.groupBy(*X).agg(near).select(*X, *(f"y.{c}" for c in Y))


def _few(df: DataFrame) -> DataFrame:
    """``df`` (a written table) to be broadcast if it is measured to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The later lines of pairs (a written table) whose words are similar enough."""
    a, b = THRESHOLD
    ends = pairs.select(*X).union(pairs.select(*Y)).distinct().toDF(*LINE)
    # Only lines that are in some pair are read as words again.
    known = durable(worded(lines).join(_few(durable(ends)), LINE, "left_semi").dropDuplicates(LINE))
    joined = pairs.join(known.toDF(*X, "xl"), X).join(known.toDF(*Y, "yl"), Y)
    sets = joined.select(*X, *(F.array_distinct(_words(F.col(c))).alias(c) for c in ("xl", "yl")))
    common = F.size(F.array_intersect("xl", "yl"))
    alike = common * (a + b) >= (F.size("xl") + F.size("yl")) * a
    return durable(sets.filter(alike).select(*X).distinct().toDF(*LINE))


def removed_lines(df: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """``(d, r, ln)``: the lines that have an earlier match, as a written table."""
    every = lines_of(df, doc_id, text, row)
    with brief_plans(df.sparkSession):  # the table of rarity classes is a literal there
        lines = durable(line_sets(every, rarity_table(df, text)))
    # Lines with one and the same set: the earliest stands for all, and only such lines meet one another.
    same = ["h", "n", "s", "u"]
    heads = durable(
        lines.groupBy(*same)
        .agg(F.min(F.struct(*LINE, "prefix")).alias("head"), F.count("*").alias("c"))
        .select(*same, "c", "head.*")
    )
    repeated = heads.filter("c > 1").select(*same, *(F.col(c).alias(f"h{c}") for c in LINE))
    copies = lines.select(*LINE, *same).join(_few(repeated), same)
    later = durable(copies.filter("hd <> d or hr <> r or hln <> ln").select(*LINE))
    joining = heads.filter(F.col("n") >= JOIN_WORDS).select(*LINE, "n", "s", "u", "prefix")
    settled = _verified(durable(against_earliest(joining)), every)
    nearest = durable(within_lists(joining, settled))
    found = _verified(nearest, every)
    gone = later.unionByName(settled).unionByName(found)
    # Lines whose nearest partner is too far may still have another one.
    few = durable(nearest.select(*X).toDF(*LINE).join(found, LINE, "left_anti"))
    if not few.isEmpty():
        gone = gone.unionByName(_verified(durable(all_partners(joining, few)), every))
    return durable(gone.distinct())


def without_removed(df: DataFrame, removed: DataFrame, doc_id: str, text: str, row: str) -> DataFrame:
    """``df`` with its text cut down to the lines that stay, and how many went."""
    key, part, gone, cut = fresh(df, "_line_id", "_line_row", "_gone", "n_removed_lines")
    per_doc = removed.groupBy(F.col("d").alias(key), F.col("r").alias(part)).agg(F.collect_list("ln").alias(gone))
    same = (_order_id(F.col(doc_id)) == F.col(key)) & (F.col(row) == F.col(part))
    joined = df.join(_few(durable(per_doc)), same, "left")
    numbered = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(numbered, lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    return joined.withColumns({text: cleaned, cut: F.coalesce(F.size(gone), F.lit(0)).cast("long")}).drop(
        key, part, gone, row
    )


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with later similar lines removed from ``text``; adds ``n_removed_lines``."""
    (row,) = fresh(df, "_row")
    keyed = with_row_key(df, doc_id, text, row)
    return without_removed(keyed, removed_lines(keyed, doc_id, text, row), doc_id, text, row)


def deduped_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with the lines that stay, in the columns of ``df``.

    A document that loses lines and has no word left is gone; ``n_chars``, where
    ``df`` has it, is set to the new length.
    """
    (name,) = fresh(df, "n_removed_lines")
    done = dedup_lines(df, doc_id, text)
    kept = done.filter((F.col(name) == 0) | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if n_chars and n_chars in df.columns:
        length = F.char_length(text).cast(df.schema[n_chars].dataType)
        kept = kept.withColumn(n_chars, F.when(F.col(name) > 0, length).otherwise(F.col(n_chars)))
    return kept.select(*df.columns)
