"""Mixing to target weights with soft domain membership.

Domains are the classes of the labelled table: ``toxic``, ``low`` (quality) and
``high``. A document belongs to each of them to a degree, the posterior of a softmax
classifier over a few dense features: how strongly the document's words lean to
one class (log-odds lexicons counted by Spark on labelled documents), and shape
features. The classifier is fitted on at most ``max_labelled`` labelled documents,
chosen by a hash of their id; everything else covers all rows.

Nonnegative rates (here at most 1: a document is not repeated) are then fitted by
least squares, so that the expected tokens per domain match the targets; of all rates
that do so equally well, those nearest to 1 are taken. Such rates are the projection
of ``1 - posterior . push`` on what is allowed, with one number of ``push`` per domain.
These few numbers are the minimum of a convex function, found by Newton steps; a step
needs sums over all rows, one distributed pass. It goes on until the optimum is met
within a tolerance that does not depend on how rare a domain is; if it is not, the
residual left is reported. Nothing per document is sent to the driver.

A document stays if the hash of its id, as a number in [0, 1), lies below its rate; one
without an id takes the hash of its text.

Null and empty texts have no words; they get the posterior of such a text. Repeated
rows get equal rates and stay or go together; different texts of one id, or without
one, are decided each for itself. An empty table gives an empty result;
without labelled documents of two classes at least, all rates are 1. Further
columns pass through.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import fresh, map_text, text_or_empty, with_row_key
from deskmill.session import durable

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.95, "low": 0.05, "toxic": 0.0}
# Labelled documents that the classifier is fitted on, at most.
MAX_LABELLED = 6_000
# Words per class lexicon, at most.
LEXICON = 2_000
# Labelled documents that must hold a word before it counts.
MIN_DOCS = 4
# Passes over the scored rows, at most; far fewer are needed to converge.
MAX_STEPS = 400
# What rates away from 1 cost beside squared residuals, as a share of the tokens: from
# large to small, each fit starting from the one before.
DAMPINGS = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7)
# Deviation from the optimum that is converged, as a share of the smallest domain's tokens.
TOLERANCE = 1e-4

log = logging.getLogger(__name__)

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


# -- the classifier ----------------------------------------------------------


class Leaning:
    """Features of a text: lexicon hits and shape."""

    def __init__(self, lexicons: list[dict[str, float]]):
        self.lexicons = lexicons

    def __call__(self, text: str) -> list[float]:
        found = words_of(text)
        n = len(found) or 1
        distinct = set(found)
        row = []
        for lexicon in self.lexicons:
            hits = [lexicon[w] for w in distinct & lexicon.keys()]
            row += [math.log1p(sum(hits)), sum(hits) / n, max(hits, default=0.0)]
        chars = len(text) or 1
        marks = sum(map(text.count, "#*$%&|<>"))
        row += [
            marks / n,
            text.count("!") / n,
            len(_UPPER.findall(text)) / chars,
            math.log1p(len(found)) / 10,
            len(distinct) / n,
        ]
        return row


_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")


def labelled_texts(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """``(domain, text)`` of at most ``max_labelled`` labelled documents, by hash of their id."""
    domain = F.expr(
        "case when toxic = 1 then 2 when quality = 0 then 1 when quality = 1 then 0 end"
    ).cast("int")
    chosen = (
        labels.select(F.col("doc_id").alias("label_id_"), domain.alias("domain"))
        .filter("domain is not null and label_id_ is not null")
        .dropDuplicates(["label_id_"])
        .join(docs.select(F.col(doc_id).alias("label_id_")).distinct(), "label_id_", "left_semi")
        .orderBy(F.xxhash64("label_id_"), "label_id_")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(doc_id).alias("label_id_"), text_or_empty(text).alias("text"))
    return F.broadcast(chosen).join(texts, "label_id_").dropDuplicates(["label_id_"]).select("domain", "text")


def lexicons(sample: DataFrame, sizes: list[int]) -> list[dict[str, float]]:
    """Per domain, the words that lean to it most: ``{word: log-odds}``.

    Words are counted per labelled document by Spark; at most ``LEXICON`` words per
    domain come to the driver.
    """
    word = F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '(?U)\\w+', 0)")))
    counts = sample.select("domain", word.alias("word")).groupBy("word").agg(
        *(F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(len(sizes)))
    )
    found = []
    counts = durable(counts)
    for d, size in enumerate(sizes):
        others = sum(sizes) - size
        inside = (F.col(f"n{d}") + 0.5) / (size + 1.0)
        rest = sum((F.col(f"n{o}") for o in range(len(sizes)) if o != d), F.lit(0))
        odds = F.log(inside / ((rest + 0.5) / (others + 1.0)))
        rows = (
            counts.filter(F.col(f"n{d}") >= MIN_DOCS)
            .select("word", odds.alias("odds"))
            .filter("odds > 1.5")
            .orderBy(F.desc("odds"), "word")
            .limit(LEXICON)
            .collect()
        )
        found.append({r.word: r.odds for r in rows})
    return found


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 400) -> dict[str, np.ndarray]:
    """Multinomial logistic regression by full-batch gradient descent with momentum."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    truth = np.eye(classes)[y]
    w = np.zeros((z.shape[1], classes))
    pace = np.zeros_like(w)
    for _ in range(steps):
        p = _softmax(z @ w)
        slope = z.T @ (p - truth) / len(z) + 1e-3 * w
        pace = 0.9 * pace - 0.5 * slope
        w += pace
    return {"mean": mean, "std": std, "w": w}


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_domains(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED
) -> dict | None:
    """The fitted classifier, or None where fewer than two domains are labelled.

    Feature rows of the bounded sample come to the driver, their texts do not.
    """
    sample = durable(labelled_texts(docs, labels, doc_id, text, max_labelled))
    sizes = [0] * len(DOMAINS)
    for r in sample.groupBy("domain").count().collect():
        sizes[r.domain] = r["count"]
    if sum(n > 0 for n in sizes) < 2:
        return None
    words = lexicons(sample, sizes)

    def make():
        leaning = Leaning(words)
        return lambda texts: [[leaning(t) for t in texts]]

    rows = map_text(sample, "text", "row_ array<double>", make).select("domain", "row_").collect()
    x = np.array([r.row_ for r in rows])
    y = np.array([r.domain for r in rows])
    return {"lexicons": words, **fit_softmax(x, y, len(DOMAINS))}


def with_posteriors(df: DataFrame, model: dict | None, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``df`` with one probability per domain and the number of words of each text."""
    names = [prefix + d for d in DOMAINS]
    fields = ", ".join(f"`{n}` double" for n in names) + f", `{prefix}words` long"

    def make():
        leaning = Leaning(model["lexicons"]) if model else None

        def step(texts):
            n_words = [len(t.split()) for t in texts]
            if leaning is None:
                return [[1.0 / len(DOMAINS)] * len(texts)] * len(DOMAINS) + [n_words]
            x = np.array([leaning(t) for t in texts])
            z = np.hstack([(x - model["mean"]) / model["std"], np.ones((len(x), 1))])
            return [*_softmax(z @ model["w"]).T, n_words]

        return step

    return map_text(df, text, fields, make)


# -- the rates ---------------------------------------------------------------


def replay(posteriors: np.ndarray, residuals: np.ndarray, step: float, highest: float) -> np.ndarray:
    """Rates after projected-gradient steps along ``residuals``, from rate 1."""
    rates = np.ones(len(posteriors))
    for residual in residuals:
        rates = np.clip(rates - step * (posteriors @ residual), 0.0, highest)
    return rates


def fit_rates(
    scored: DataFrame,
    names: list[str],
    weight: str,
    targets: Mapping[str, float],
    max_steps: int = MAX_STEPS,
    highest: float = 1.0,
) -> tuple[np.ndarray, float]:
    """Residuals (one row) and the step size, as :func:`replay` takes them: all that a
    document's rate needs.

    The corpus size aimed at is the largest that needs no domain to exceed what it
    has, given the weights. ``scored`` should be a written table, as each pass reads it.
    """
    p = [F.col(f"`{n}`") for n in names]
    w = F.col(weight)
    cells = [F.sum(w * a * b) for i, a in enumerate(p) for b in p[i:]]
    row = scored.agg(*(F.sum(w * a).alias(f"t{i}") for i, a in enumerate(p)), *cells).first()
    have = np.array([float(v or 0.0) for v in row[: len(p)]])
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    if have.sum() <= 0 or share.sum() <= 0:
        return np.zeros((0, len(p))), 0.0
    share = share / share.sum()
    # The domain with the largest weight is taken whole; the others follow from it.
    lead = int(share.argmax())
    want = np.minimum(share * have[lead] / share[lead], np.where(share > 0, have, 0.0))
    gram = np.zeros((len(p), len(p)))
    cells_left = list(row[len(p) :])
    for i in range(len(p)):
        for j in range(i, len(p)):
            gram[i, j] = gram[j, i] = float(cells_left.pop(0) or 0.0)
    push, left, passes = fit_push(scored, names, weight, want, have, gram, max_steps, highest)
    if left > 1.0:
        log.warning("mixing: rates not converged after %d passes, %.3g times the tolerance left", passes, left)
    return push[None, :], 1.0


def fit_push(scored, names, weight, want, have, gram, max_steps, highest) -> tuple[np.ndarray, float, int]:
    """The push of the nearest rates to 1 with least squares, how many times the tolerance
    it is off the optimum, and the passes taken.

    Newton steps on the dual function, damped where need be: a pass tries a grid of
    dampings and lengths at once and the best goes on.
    """
    total = have.sum()
    near = TOLERANCE * have[have > 0].min()
    push = np.zeros(len(want))
    passes, left = 0, np.inf
    for damping in DAMPINGS:
        cost = damping * total
        trials = push[None, :]
        best = None
        while passes < max_steps:
            passes += 1
            values, sums, grams = measures(scored, names, weight, trials, highest)
            values = values + trials @ want + cost / 2 * (trials**2).sum(axis=1)
            at = int(np.argmin(values))
            if best is not None and not values[at] < best:
                break  # as near as the numbers tell
            best, push = values[at], trials[at]
            slope = want + cost * push - sums[at]
            left = float(np.abs(slope).max() / near)
            if left <= 1.0:
                break
            bend = grams[at] + cost * np.eye(len(want))
            scale = np.trace(gram)
            steps = [
                np.linalg.solve(bend + mu * scale * np.eye(len(want)), slope)
                for mu in (0.0, 1e-8, 1e-6, 1e-4, 1e-2, 1.0)
            ]
            trials = np.array([push - part * s for s in steps for part in (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)])
    return push, left, passes


def measures(scored, names, weight, trials, highest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per trial push: the value of the dual function's sum over the rows, the expected
    tokens per domain, and their derivatives by the push (negated)."""
    chosen = scored.select(weight, *(f"`{n}`" for n in names))
    n, k = len(trials), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, 1 + k + k * k))
        for batch in batches:
            if batch.num_rows:
                w, p = _matrix(batch)
                pairs = (p[:, :, None] * p[:, None, :]).reshape(-1, k * k)
                for i, push in enumerate(trials):
                    free = 1.0 - p @ push
                    rates = np.clip(free, 0.0, highest)
                    inside = (free > 0.0) & (free <= highest)
                    total[i, 0] += w @ (rates * free - rates**2 / 2)
                    total[i, 1 : 1 + k] += (w * rates) @ p
                    total[i, 1 + k :] += (w * inside) @ pairs
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"]
        )

    parts = chosen.mapInArrow(run, "i long, sums array<double>")
    rows = parts.groupBy("i").agg(*(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(1 + k + k * k))).collect()
    out = np.zeros((n, 1 + k + k * k))
    for r in rows:
        out[r.i] = r[1:]
    return out[:, 0], out[:, 1 : 1 + k], out[:, 1 + k :].reshape(n, k, k)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
    return columns[0], np.column_stack(columns[1:])


def with_rates(scored: DataFrame, names: list[str], residuals, step, name: str, highest: float = 1.0) -> DataFrame:
    """``scored`` with each document's rate, replayed from its posteriors in the JVM."""
    rate: Column = F.lit(1.0)
    if len(residuals):
        rows = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in residuals))
        posterior = [F.col(f"`{n}`") for n in names]

        def follow(rate, residual):
            slope = sum((residual[i] * q for i, q in enumerate(posterior)), F.lit(0.0))
            return F.least(F.lit(float(highest)), F.greatest(F.lit(0.0), rate - F.lit(step) * slope))

        rate = F.aggregate(rows, F.lit(1.0), follow)
    return scored.withColumn(name, rate)


def lot(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) drawn by the hash of an id, or of the text where that is null."""
    drawn = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(8))).otherwise(F.xxhash64(doc_id, F.lit(8)))
    return F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    doc_id: str = "doc_id",
    text: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``docs`` without its text, with posteriors ``p_*``, ``p_words``, ``rate`` and ``kept``.

    The result's columns of its own are prolonged where ``docs`` has such names.
    """
    model = fit_domains(docs, labels, doc_id, text, max_labelled)
    prefix, rate, kept = fresh(docs, "p_", "rate", "kept")
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    draw = prefix + "lot"
    drawn = with_posteriors(docs, model, text, prefix).withColumn(draw, lot(F.col(doc_id), F.col(text)))
    scored = durable(drawn.drop(text))
    names = [prefix + d for d in DOMAINS]
    residuals, step = (
        fit_rates(scored, names, prefix + "words", targets) if model else (np.zeros((0, 3)), 0.0)
    )
    rated = with_rates(scored, names, residuals, step, rate)
    return rated.withColumn(kept, F.col(draw) < F.col(rate)).drop(draw)


def mixed_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that the fitted rates keep, in the columns of ``docs``."""
    row, key, part = fresh(docs, "_row", "_gone_id", "_gone_row")
    keyed = with_row_key(docs, doc_id, text, row)
    decided = mix(keyed.select(doc_id, row, text), labels, doc_id=doc_id, text=text, **settings)
    gone = decided.filter("not kept").select(F.col(doc_id).alias(key), F.col(row).alias(part)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(row) == F.col(part))
    return keyed.join(gone, same, "left_anti").drop(row)
