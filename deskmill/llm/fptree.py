"""Ranked lexical search over FP-trees of documents.

Every document is reduced to the terms that some item asks for, ordered by how many
documents hold them, most frequent first. In these orders documents share prefixes, so a
block of documents forms a trie whose nodes are runs of the sorted block. A node keeps the
largest ``tf`` of each term in its subtree and the smallest length factor ``m``; with them
``sum w * (10^9 tf div (1000 tf + 20 m))`` bounds the score of every document below it. An
item walks the trie depth first, most promising child first, and turns back where the
bound is below its 50th best score so far. Documents in reached leaves are scored exactly.

A task holds one block at a time and keeps each item's best over all its blocks, so later
blocks are cut harder; the tasks' lists meet in one ranked window per item. Term weights
and length factors come from all documents. Items are taken in blocks of bounded text;
each block of items is searched against all documents, none is left out.

Null texts have no terms; such documents and items without terms rank nowhere. Rows of
one item id (null included) are one item with the terms of all its texts, once each. Every
document row is ranked, repeated ones too; equal scores rank by document id, null ids
last. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.common import text_or_empty
from deskmill.session import durable

TOP = 50
# Documents of one trie, and of one leaf at most before it is split along the trie.
BLOCK_DOCS = 8_192
LEAF_DOCS = 24
# Terms of all documents of one trie together, where few documents have very many.
BLOCK_ENTRIES = 4_000_000
# Characters of item texts whose terms are held by every task at once.
ITEM_CHARS = 8_000_000

# Bytes that may stand in a term: ASCII letters and digits, and all of any other script.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, term``: the distinct terms of each item."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, body in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for term in set(terms_of(body)):
                    ids.append(i)
                    found.append(term)
            taken = batch.column(0).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(found, pa.binary()).cast(pa.string())], names=["item", "term"])

    rows = items.select(F.col(item_id).alias("item"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, term string").distinct()


def restricted(docs: DataFrame, doc_id: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs``: the terms asked for and how often each occurs, by number."""
    kind = docs.schema[doc_id].dataType.simpleString()
    spread = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for body in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(body)
                lengths.append(len(words))
                counted = Counter(filter(known.__contains__, words))
                terms.append([known[t] for t in counted])
                tfs.append(list(counted.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per unit of its weight; grows with ``tf`` and falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Trie:
    """The trie of one block: documents in path order, nodes as runs of them.

    ``paths`` are the documents' term ranks in ascending order, ``tfs`` go with them. Nodes
    are numbered so that the children of a node are neighbours.
    """

    def __init__(self, paths: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, leaf: int = LEAF_DOCS):
        order = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        self.order = np.array(order, np.int64)
        self.m = m[self.order]
        sizes = np.array([len(paths[i]) for i in order], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([paths[i] for i in order]) if order else np.zeros(0, np.int64)
        self.tf = np.concatenate([tfs[i] for i in order]) if order else np.zeros(0, np.int64)
        self.gain = gain(self.tf, np.repeat(self.m, sizes))
        shared = [0] * len(order)
        for i in range(1, len(order)):
            a, b = paths[order[i - 1]], paths[order[i]]
            size = min(len(a), len(b))
            differ = np.flatnonzero(a[:size] != b[:size])
            shared[i] = int(differ[0]) if len(differ) else size
        self._grow(np.array(shared, np.int64), leaf)

    def _grow(self, shared: np.ndarray, leaf: int) -> None:
        """Split the run of all documents where paths part, until runs are leaves.

        Neighbouring children of few documents share a node: a bound over more documents
        is still a bound.
        """
        runs, self.children = [(0, len(self.m))], {}
        node = 0
        while node < len(runs):
            low, high = runs[node]
            if high - low > leaf:
                inner = shared[low + 1 : high]
                cuts = np.flatnonzero(inner == inner.min()) + low + 1
                borders, last = [low], low
                for cut, following in zip(cuts.tolist(), [*cuts[1:].tolist(), high]):
                    if following - last > leaf and cut > last:
                        borders.append(cut)
                        last = cut
                if len(borders) == 1:  # one path holds nearly all: halve the run
                    borders.append((low + high) // 2)
                borders.append(high)
                first = len(runs)
                runs += zip(borders, borders[1:])
                self.children[node] = (first, len(runs))
            node += 1
        self.runs = runs
        self._bound()

    def _bound(self) -> None:
        """Subtree maxima of ``tf`` per term and minima of ``m``, from the leaves up."""
        n = len(self.runs)
        least = np.zeros(n, np.int64)
        maxima: list = [None] * n
        for node in range(n - 1, -1, -1):
            low, high = self.runs[node]
            if node in self.children:
                first, end = self.children[node]
                terms = np.concatenate([maxima[c][0] for c in range(first, end)])
                tfs = np.concatenate([maxima[c][1] for c in range(first, end)])
                least[node] = least[first:end].min()
            else:
                part = slice(self.at[low], self.at[high])
                terms, tfs = self.terms[part], self.tf[part]
                least[node] = self.m[low:high].min() if high > low else 0
            order = np.lexsort((tfs, terms))
            terms, tfs = terms[order], tfs[order]
            last = np.ones(len(terms), bool)
            last[:-1] = terms[1:] != terms[:-1]
            maxima[node] = (terms[last], tfs[last])
        sizes = np.array([len(t) for t, _ in maxima], np.int64)
        self.node_at = np.concatenate([[0], np.cumsum(sizes)])
        self.node_terms = np.concatenate([t for t, _ in maxima])
        self.node_gain = gain(np.concatenate([t for _, t in maxima]), np.repeat(least, sizes))

    def search(self, weights: np.ndarray, least: Callable[[], int], offer: Callable[[int, int], None]) -> int:
        """Offer ``(score, position)`` of every document that may still count; returns how many were scored.

        ``weights`` holds the item's weight per term, zero elsewhere; a subtree whose bound
        is below ``least()``, or zero, holds nothing to offer.
        """
        open_, scored = [(None, 0)], 0
        while open_:
            bound, node = open_.pop()
            if bound is not None and bound < max(least(), 1):
                continue
            if node in self.children:
                first, end = self.children[node]
                bounds = _sums(weights, self.node_terms, self.node_gain, self.node_at, first, end)
                floor = max(least(), 1)
                for child in np.argsort(bounds, kind="stable").tolist():
                    if bounds[child] >= floor:
                        open_.append((int(bounds[child]), first + child))
                continue
            low, high = self.runs[node]
            scores = _sums(weights, self.terms, self.gain, self.at, low, high)
            scored += high - low
            for i in np.flatnonzero(scores >= max(least(), 1)).tolist():
                offer(int(scores[i]), low + i)
        return scored


def _sums(weights: np.ndarray, terms: np.ndarray, gains: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Weighted gains summed over each of the runs ``low`` to ``high``."""
    start, end = at[low], at[high]
    total = np.zeros(end - start + 1, np.int64)
    np.cumsum(weights[terms[start:end]] * gains[start:end], out=total[1:])
    marks = total[at[low : high + 1] - start]
    return marks[1:] - marks[:-1]


class Best:
    """The ``top`` best documents of one item; ties go to the smaller key."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def least(self) -> int:
        """Scores below cannot enter; an equal one may, by its id."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, score: int, key: tuple, doc: object) -> None:
        # the smallest key ranks first, so it leaves the heap last
        entry = (score, _Last(key), doc)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry[:2] > self.heap[0][:2]:
            heapq.heapreplace(self.heap, entry)


class _Last:
    """A key that compares the other way round."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: _Last) -> bool:
        return other.key < self.key

    def __eq__(self, other: object) -> bool:
        return self.key == other.key


def _search_block(
    vectors: DataFrame,
    ranks: np.ndarray,
    wanted: list[tuple[int, list[int]]],
    weights: list[int],
    n_docs: int,
    n_terms: int,
    top: int,
) -> DataFrame:
    """``item_no, doc_id, score``: each task's best documents per item.

    ``ranks`` numbers the terms of ``vectors`` by frequency; ``wanted`` and ``weights`` use its numbers.
    """
    kind = vectors.schema["doc_id"].dataType.simpleString()
    spread = vectors.sparkSession.sparkContext.broadcast((ranks, wanted, np.array(weights, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, items, weight = spread.value
        best = [Best(top) for _ in items]
        dense = np.zeros(len(weight), np.int64)
        ids: list = []
        paths, tfs, lengths = [], [], []

        def search() -> None:
            # as many documents as the corpus has may push 50 n N beyond 64 bits
            m = np.array([50 + (50 * n * n_docs) // n_terms for n in lengths], np.int64)
            trie = Trie(paths, tfs, m)
            for (_, terms), found in zip(items, best):
                dense[terms] = weight[terms]
                trie.search(
                    dense,
                    found.least,
                    lambda score, at, found=found: found.offer(score, *_keyed(ids[trie.order[at]])),
                )
                dense[terms] = 0

        kind_of_id, entries = None, 0
        for batch in batches:
            kind_of_id = batch.column(0).type
            sizes = batch.column(1).to_pylist()
            held, counts = batch.column(2), batch.column(3)
            terms, offsets = rank[held.values.to_numpy()].astype(np.int64), held.offsets.to_numpy()
            numbers, shifts = counts.values.to_numpy(), counts.offsets.to_numpy()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                low, high = offsets[i], offsets[i + 1]
                if low == high:
                    continue
                order = np.argsort(terms[low:high])
                ids.append(doc)
                paths.append(terms[low:high][order])
                tfs.append(numbers[shifts[i] : shifts[i + 1]][order])
                lengths.append(sizes[i])
                entries += high - low
                if len(ids) == BLOCK_DOCS or entries > BLOCK_ENTRIES:
                    search()
                    entries = 0
                    for part in (ids, paths, tfs, lengths):
                        part.clear()
        if ids:
            search()
        rows = [(no, doc, score) for (no, _), found in zip(items, best) for score, _, doc in found.heap]
        if rows:
            no, docs, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(no, pa.int32()), pa.array(docs, kind_of_id), pa.array(scores, pa.int64())],
                names=["item_no", "doc_id", "score"],
            )

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item_no int, doc_id {kind}, score long")


def _keyed(doc: object) -> tuple[tuple, object]:
    return (doc is None, 0 if doc is None else doc), doc


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item."""
    asked = durable(term_sets(items, item_id, item_text))
    size = asked.agg(F.sum(F.char_length("term") + 1)).first()[0] or 0
    blocks = 1 + size // item_chars
    found = None
    for block in range(blocks):
        # a bounded share of the items: its terms are held by every task
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        ranked = _search_items(docs, doc_id, text, mine, top)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _search_items(docs: DataFrame, doc_id: str, text: str, asked: DataFrame, top: int) -> DataFrame:
    by_item: dict = {}
    for row in asked.collect():
        by_item.setdefault(row.item, []).append(row.term.encode())
    numbers = {t: i for i, t in enumerate(sorted({t for terms in by_item.values() for t in terms}))}
    vectors = durable(restricted(docs, doc_id, text, numbers))
    size = vectors.agg(F.sum(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = size.docs or 0, size.terms or 0
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(
        F.count("*").alias("df"),
        F.floor(1000 * F.log((F.lit(2 * n_docs + 2)).cast("double") / (2 * F.count("*") + 1))).cast("long").alias("w"),
    )
    # one row per term of this block of items
    known = held.orderBy(F.desc("df"), "t").collect()
    rank = {row.t: i for i, row in enumerate(known)}
    names = list(by_item)
    wanted = [
        (no, sorted(rank[numbers[t]] for t in by_item[name] if numbers[t] in rank)) for no, name in enumerate(names)
    ]
    kind = asked.schema["item"].dataType.simpleString()
    labels = docs.sparkSession.createDataFrame([(no, name) for no, name in enumerate(names)], f"item_no int, item_id {kind}")
    frequent_first = np.full(len(numbers) + 1, -1, np.int32)
    for number, at in rank.items():
        frequent_first[number] = at
    hits = _search_block(vectors, frequent_first, wanted, [row.w for row in known], n_docs, n_terms, top)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(labels, "item_no")
        .select("item_id", "rank", "doc_id", "score")
    )


#: The same rows in SQL, for ``documents`` and ``benchmark`` as views.
_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS terms FROM documents
), asked AS (
    SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), size AS (
    SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS terms FROM d
), tf AS (
    SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size
), scored AS (
    SELECT a.item_id, d.doc_id, d.i, sum(w * ((1000000000 * tf) // (1000 * tf
        + 20 * (50 + (50 * len(d.terms) * size.docs) // size.terms))))::BIGINT AS score
    FROM asked a JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (i), size
    GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
