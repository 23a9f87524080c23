"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends (``trim`` knows only blanks)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_silent(speech: Column) -> Column:
    """NULL or empty speech; blanks alone count as speech."""
    return speech.isNull() | (speech == "")
