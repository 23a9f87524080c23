"""Masking on a stream: the batch function, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from deskmill.functions.pii import mask_pii


def stream_pii_mask(stream: DataFrame, column: str) -> DataFrame:
    """The stream with ``masked`` and ``mapping``; keeps no state."""
    return mask_pii(stream, column)
