"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept, and
returns a DataFrame; :func:`run` writes each as Parquet and reads it again for the next.
All but the last return the columns of ``docs``.

1. ``quality_rules``: failing lines go, documents the rules reject go.
2. ``line_dedup``: later lines similar to an earlier one go; a document left without a
   word goes.
3. ``near_dedup``: of each component of near fingerprints the smallest id stays. It links
   at the distance that the operator's contract fixes (three-word shingles, two bits).
4. ``mixing``: documents stay with the rate that brings the domains to their weights.
5. ``packing``: what stays is tokenised and packed into sequences, one row per piece.

Null ids, null and empty texts, repeated rows, empty tables and further columns are
treated as the operators say; no stage needs any column but id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskmill.llm import linedup, mixing, packing, quality, simhash
from deskmill.llm.common import small_batches, table
from deskmill.session import durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.deduped_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.one_of_each(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def packing_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("packing", packing_pieces),
]

#: SQL can express neither set joins nor fitted rates over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
