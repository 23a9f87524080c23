"""Predicates that let rows through, and the outbound table behind them."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.pii import mask_pii
from deskmill.functions.text import is_silent, strip

# Replies, the escalation threshold, providers in order of choice.
REPROMPT = "I didn't catch that. Could you repeat?"
NO_TRANSCRIPT = "Transcription failed"
ESCALATE_BELOW = 0.7
PROVIDERS = ("openai", "anthropic")


def split_silent(turns: DataFrame, column: str = "speech_result") -> tuple[DataFrame, DataFrame]:
    """``(silent, spoken)`` turns; the silent ones carry the reprompt as ``reply``."""
    silent = is_silent(F.col(column))
    return turns.filter(silent).withColumn("reply", F.lit(REPROMPT)), turns.filter(~silent)


def gate_transcripts(df: DataFrame, column: str = "transcript") -> DataFrame:
    """Stripped ``text``, or the ``error`` where nothing is left."""
    text = F.coalesce(strip(F.col(column)), F.lit(""))
    return df.withColumn("text", F.nullif(text, F.lit(""))).withColumn(
        "error", F.when(F.col("text").isNull(), NO_TRANSCRIPT)
    )


def needs_cloud(use_cloud: Column, confidence: Column) -> Column:
    """Escalate only on demand and at low confidence (unknown counts as certain)."""
    wanted = F.coalesce(use_cloud, F.lit(False))
    return wanted & (F.coalesce(confidence, F.lit(1.0)) < ESCALATE_BELOW)


def consent_gate(df: DataFrame, enabled: bool, consent: str = "user_consent") -> DataFrame:
    """Only rows that may leave; NULL consent is no consent."""
    return df.filter(F.lit(enabled) & F.coalesce(F.col(consent), F.lit(False)))


def choose_provider(configured: Collection[str]) -> Column:
    """First configured provider, NULL when there is none."""
    chosen = next((name for name in PROVIDERS if name in configured), None)
    return F.lit(chosen).cast("string")


def outbound(
    df: DataFrame, id_col: str, text: str, configured: Collection[str], enabled: bool = True
) -> DataFrame:
    """Masked prompts with their provider. Originals and mapping stay behind."""
    wanted = df.filter(needs_cloud(F.col("use_cloud"), F.col("confidence")))
    allowed = consent_gate(wanted, enabled).withColumn("provider", choose_provider(configured))
    masked = mask_pii(allowed.filter(F.col("provider").isNotNull()), text, "prompt")
    return masked.select(id_col, "provider", "prompt")


def write_outbound(sent: DataFrame, path: str) -> None:
    """Append outbound rows, one folder per provider: what a sender picks up."""
    sent.write.mode("append").partitionBy("provider").parquet(path)
