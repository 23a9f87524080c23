"""Dialogue context of a session from the turns before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.operators.ids import in_ranges


def with_previous(
    df: DataFrame, key: str, order: list[str], carried: dict[str, str]
) -> DataFrame:
    """Add columns of the row before, within ``key`` and by ``order``.

    ``carried`` maps new column names to existing ones. Rows without a key get no
    context. The rows are cut into ranges of key and order: the row before is looked up
    within the range, and only the first row of a key in a range takes the key's last
    row of an earlier one. So a task's share does not depend on how the keys are
    spread, and one row per key and range is carried across.
    """
    payload = "struct(" + ", ".join(f"{src} AS {new}" for new, src in carried.items()) + ")"
    rows = in_ranges(df, [key, *order])
    within = Window.partitionBy(key, "_range").orderBy(*order)
    ranges = Window.partitionBy(key).orderBy("_range")
    placed = rows.withColumn("_before", F.lag(F.expr(payload)).over(within))
    last_of_range = (
        rows.withColumn("_is_last", F.lead(F.lit(True)).over(within).isNull())
        .filter(F.col("_is_last") & F.col(key).isNotNull())
        .select(key, "_range", F.expr(payload).alias("_last"))
        .select(key, "_range", F.lag("_last").over(ranges).alias("_carry"))
    )
    return (
        placed.join(last_of_range, [key, "_range"], "left")
        .withColumns(
            {
                new: F.expr(f"CASE WHEN {key} IS NOT NULL THEN coalesce(_before, _carry).{new} END")
                for new in carried
            }
        )
        .drop("_range", "_before", "_carry")
    )


def with_context(turns: DataFrame) -> DataFrame:
    """Turns with ``prev_intent`` and ``prev_response`` of their session.

    A NULL or empty ``session_id`` is no session.

    Needs ``session_id, ts, event_id, intent, response``. Intents do not depend on
    the context unless a model reads it, so they are computed before this step.
    """
    session = F.nullif(F.col("session_id"), F.lit(""))
    return with_previous(
        turns.withColumn("_session", session),
        "_session",
        ["ts", "event_id"],
        {"prev_intent": "intent", "prev_response": "response"},
    ).drop("_session")
