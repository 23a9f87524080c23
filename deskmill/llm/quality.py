"""Quality rules, line first.

Every line is judged on its own: punctuation (symbols for prose, shouting),
navigation (short lines that end no sentence, lists of links) and boilerplate
(phrases of legal and cookie notices, as whole words, where they make up half of the
line, where there are several, or a legal formula in a short line). Failing lines are removed; a document that
loses too large a share of its text, or fails the base rules on its whole text, is
rejected.

Nulls and empty texts have no words and are rejected by the base rules. Repeated
rows are judged alike, each for itself; an empty table stays empty; further columns
pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import fresh, map_text

# The characters the base rules count.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

# Phrases of notices that are no prose, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "enable javascript",
    "click here",
    "read more",
    "sign in",
    "log in",
    "subscribe to our newsletter",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutz",
    "impressum",
    "tous droits réservés",
    "mentions légales",
    "todos los derechos reservados",
    "política de privacidad",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds; the base rules use the first two."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbols_per_word: float = 0.1
    marks_per_word: float = 0.5
    upper_share: float = 0.6
    short_words: int = 8
    notice_words: int = 40
    max_lost: float = 0.2


_ENDS = tuple(".!?…:;。！？؟।\"'”’»)]")
_LETTERED = re.compile(r"[^\W\d_]")
_NOTICE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, BOILERPLATE))})(?!\w)")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]~^=\\@_]")
_MARK = re.compile(r"[!?]")
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽ]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    if size == n:
        return 0
    pairs = codes[:-1] * size + codes[1:]
    if size > 1_000_000:  # a third factor would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * size + codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= again
    return int(marked.sum())


def failing_rule(line: str, n_words: int, rules: Rules) -> str | None:
    """The rule a line of ``n_words`` words fails, or None."""
    if len(_SYMBOL.findall(line)) > rules.symbols_per_word * n_words:
        return "punctuation"
    if len(_MARK.findall(line)) > max(1.0, rules.marks_per_word * n_words):
        return "punctuation"
    upper = len(_UPPER.findall(line)) if n_words >= 3 else 0
    # Few capitals in the line are few among its letters: most lines end here.
    if upper > 0.1 * len(line) and upper > rules.upper_share * len(_LETTERED.findall(line)):
        return "shouting"
    if n_words < rules.short_words and not line.rstrip().endswith(_ENDS):
        return "navigation"
    if not _LETTERED.search(line):
        return "navigation"
    if n_words <= rules.notice_words and _is_notice(_NOTICE.findall(line.lower()), n_words, rules):
        return "boilerplate"
    return None


def _is_notice(phrases: list[str], n_words: int, rules: Rules) -> bool:
    """Whether a line of ``n_words`` words that holds ``phrases`` is a notice, not a sentence about one."""
    if not phrases:
        return False
    in_phrase = [len(p.split()) for p in phrases]
    formula = max(in_phrase) >= 3 and n_words <= rules.short_words
    return len(set(phrases)) > 1 or 2 * sum(in_phrase) >= n_words or formula


def judge(text: str, rules: Rules) -> tuple:
    """The measures, the verdict and the cleaned text of one document."""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    kept_lines, n_dup, n_failed, lost = [], 0, 0, 0
    for line in text.split("\n"):
        in_line = len(line.encode().split())
        if not in_line:
            kept_lines.append(line)
            continue
        if line in seen:
            n_dup += 1
        else:
            seen.add(line)
        if failing_rule(line, in_line, rules):
            n_failed += 1
            lost += len(line) - sum(map(line.count, BLANKS))
        else:
            kept_lines.append(line)
    n_repeat = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_lost * word_chars
    cleaned = "\n".join(kept_lines) if n_failed else text
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, n_failed, lost, cleaned)


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_failed_lines long, lost_chars long, cleaned string"
)


def with_verdict(df: DataFrame, text: str = "text", rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """``df`` with the measures of :func:`judge`, their names behind ``prefix``."""
    fields = ", ".join(prefix + part.strip() for part in FIELDS.split(","))

    def make():
        return lambda texts: list(zip(*(judge(t, rules) for t in texts)))

    return map_text(df, text, fields, make)


def clean_documents(
    df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rules: Rules = Rules()
) -> DataFrame:
    """The documents kept, without their failing lines, in the columns of ``df``.

    ``n_chars``, where ``df`` has it, is set to the length of the cleaned text.
    """
    (prefix,) = fresh(df, "_rule_")
    judged = with_verdict(df, text, rules, prefix).filter(F.col(f"{prefix}kept"))
    cleaned = F.col(f"{prefix}cleaned")
    out = {text: cleaned}
    if n_chars and n_chars in df.columns:
        out[n_chars] = F.char_length(cleaned).cast(df.schema[n_chars].dataType)
    return judged.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns))
