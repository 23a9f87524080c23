"""Reversible masking of personal data with built-in regex functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three kinds of personal data, in the order they are masked.
_ASCII = {
    "EMAIL": r"\b[\w\.-]+@[\w\.-]+\.\w+\b",
    "PHONE": r"\b\+?[\d\-\(\)]{10,}\b",
    "NAME": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
}

# The same patterns for text outside ASCII. Java's own \w and \b differ from the
# intended ones there, so letters, numbers and the word edge are spelled out. The
# look-ahead only spares the costly edge test where no match can begin.
_W = r"\p{L}\p{N}_"
_EDGE = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
_WIDE = {
    "EMAIL": rf"{_EDGE}[{_W}.\-]+@[{_W}.\-]+\.[{_W}]+{_EDGE}",
    "PHONE": rf"(?=[+\p{{Nd}}\-()]){_EDGE}\+?[\p{{Nd}}\-()]{{10,}}{_EDGE}",
    "NAME": rf"(?=[A-Z]){_EDGE}[A-Z][a-z]+ [A-Z][a-z]+{_EDGE}",
}

# What stands for personal data in a masked text, and so for itself in a text that came with it.
PLACEHOLDER = r"\[(?:EMAIL|PHONE|NAME|LITERAL)_[0-9]{1,9}\]"

_NONE = "array<string>"


def _patterns(kind: str) -> tuple[str, str]:
    """The pattern for ASCII texts and the one for all others."""
    return (PLACEHOLDER, PLACEHOLDER) if kind == "LITERAL" else (_ASCII[kind], _WIDE[kind])


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _found(text: Column, kind: str) -> Column:
    def extract(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    narrow, wide = _patterns(kind)
    found = F.when(_is_ascii(text), extract(narrow)).otherwise(extract(wide))
    # no "@", no address, no bracket, no placeholder: skips the scan for nearly every text
    sign = {"EMAIL": "@", "LITERAL": "["}.get(kind)
    if sign:
        found = F.when(text.isNull() | text.contains(sign), found).otherwise(
            F.array().cast(_NONE)
        )
    return found


def _substituted(text: Column, found: Column, keys: Column, kind: str) -> Column:
    """``text`` with its n-th match replaced by the n-th key."""

    def pieces(pattern: str) -> Column:
        return F.split(text, pattern, -1)

    narrow, wide = _patterns(kind)
    between = F.when(_is_ascii(text), pieces(narrow)).otherwise(pieces(wide))
    woven = F.transform(
        between, lambda piece, i: F.concat(piece, F.coalesce(F.get(keys, i), F.lit("")))
    )
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(woven, ""))


def _keys(found: Column, kind: str, taken: Column) -> Column:
    return F.transform(
        found,
        lambda _, i: F.concat(F.lit(f"[{kind}_"), (taken + i).cast("string"), F.lit("]")),
    )


def mask_pii(
    df: DataFrame, column: str, masked: str = "masked", mapping: str = "mapping", literals: bool = False
) -> DataFrame:
    """Add the masked text and the map from placeholder to original.

    Kinds are masked one after the other, each on the result of the one before.
    Every occurrence gets its own number, running through all kinds of the row.
    Stateless, so it serves batch and streaming frames alike. With ``literals`` what looks
    like a placeholder in the text itself is masked before anything else, so that every
    text can be put back.
    """
    text = F.col(column)
    taken = F.lit(0)
    helper: list[str] = []
    keys: list[Column] = []
    values: list[Column] = []
    for kind in (["LITERAL"] if literals else []) + list(_ASCII):
        found, named, out = f"_{kind}_found", f"_{kind}_keys", f"_{kind}_text"
        df = df.withColumn(found, _found(text, kind))
        df = df.withColumn(named, _keys(F.col(found), kind, taken))
        df = df.withColumn(out, _substituted(text, F.col(found), F.col(named), kind))
        text = F.col(out)
        taken = taken + F.size(found)
        helper += [found, named, out]
        keys.append(F.col(named))
        values.append(F.col(found))
    df = df.withColumn(masked, text)
    df = df.withColumn(mapping, F.map_from_arrays(F.concat(*keys), F.concat(*values)))
    return df.drop(*helper)


def pii_entries(df: DataFrame, mapping: str = "mapping") -> DataFrame:
    """One row per masked occurrence: ``position``, ``placeholder``, ``original``."""
    rest = [c for c in df.columns if c != mapping]
    return df.select(
        *rest, F.posexplode(F.map_entries(mapping)).alias("position", "entry")
    ).select(
        *rest,
        "position",
        F.col("entry.key").alias("placeholder"),
        F.col("entry.value").alias("original"),
    )


def unmask(masked: Column, mapping: Column) -> Column:
    """Put the originals back, in one pass over the text.

    The number of a placeholder is its place in the mapping, so each is found at once, however
    many there are. What is put back is not looked at again. Placeholders without an
    original stay. A text that held placeholders before masking comes back whole only where it
    was masked with ``literals``.
    """
    names, originals = F.map_keys(mapping), F.map_values(mapping)

    def woven(piece: Column, hit: Column) -> Column:
        at = F.regexp_extract(hit, "[0-9]+", 0).cast("int")
        known = F.when(F.get(names, at) == hit, F.get(originals, at)).otherwise(F.try_element_at(mapping, hit))
        return F.concat(piece, F.coalesce(known, hit, F.lit("")))

    pieces = F.split(masked, PLACEHOLDER, -1)
    hits = F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(0))
    return F.when(F.size(mapping) > 0, F.array_join(F.zip_with(pieces, hits, woven), "")).otherwise(masked)
