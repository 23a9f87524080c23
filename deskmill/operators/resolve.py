"""Choice between the local intent and one from a cloud reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.intents import parse_replies
from deskmill.operators.gates import needs_cloud


def resolve_intents(local: DataFrame, cloud: DataFrame, on: str = "request_id") -> DataFrame:
    """``local`` rows with the cloud intent where one was due and has arrived.

    ``local`` needs ``intent, confidence, entities, use_cloud``, ``cloud`` a
    ``reply``. A replaced row has ``source = 'cloud'``.
    """
    replies = parse_replies(
        cloud.filter("reply IS NOT NULL AND reply != ''"), "reply", "_cloud"
    ).select(on, "_cloud")
    due = needs_cloud(F.col("use_cloud"), F.col("confidence"))
    taken = F.col("_taken")
    joined = local.join(replies, on, "left").withColumn(
        "_taken", due & F.col("_cloud").isNotNull()
    )
    chosen = {
        name: F.when(taken, F.col(f"_cloud.{name}")).otherwise(F.col(name))
        for name in ("intent", "confidence", "entities")
    }
    return joined.withColumns({**chosen, "source": F.when(taken, "cloud")}).drop("_cloud", "_taken")
