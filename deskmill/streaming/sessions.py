"""Dialogue context over an unbounded stream of turns."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = T.StructType(
    [T.StructField("intent", T.StringType()), T.StructField("response", T.StringType())]
)

# Keys of turns that pass by the state, and over how many groups they spread.
_PASSING = "\x00"
_SPREAD = 1024


def stream_sessions(
    turns: DataFrame, key: str = "session_id", ttl: timedelta | None = None, passing: str | None = None
) -> DataFrame:
    """Turns with ``prev_intent`` and ``prev_response``, kept as state per session.

    Needs ``ts, event_id, intent, response``. Within a micro-batch turns count in
    the order of time and id, across micro-batches in the order they come. The
    state of a session is two strings. Without ``ttl`` it is kept for ever; with it
    (and a watermark on ``ts``) a session is forgotten that long after its last
    turn. The source is read once: turns without a session, and those of the boolean column
    ``passing``, go through the same step and neither see nor leave a state. Bound the
    micro-batch at the source: one session's turns of one micro-batch are ordered in one task.
    """
    zone = turns.sparkSession.conf.get("spark.sql.session.timeZone")
    if ttl is not None and zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError(f"deadlines are kept in UTC; the session's zone is {zone}")
    before = [T.StructField(n, T.StringType()) for n in ("prev_intent", "prev_response")]
    schema = T.StructType([*turns.schema.fields, *before])
    timeout = (
        GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    )

    def follow(
        session: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if session[0].startswith(_PASSING):  # chunk by chunk, in no order
            for batch in batches:
                yield batch.drop(columns="_session").assign(prev_intent=None, prev_response=None)
            return
        rows = pd.concat(list(batches), ignore_index=True).drop(columns="_session")
        rows = rows.sort_values(["ts", "event_id"], kind="stable")
        last = state.get if state.exists else (None, None)
        for name, source, first in zip(
            ("prev_intent", "prev_response"), ("intent", "response"), last
        ):
            rows[name] = [first, *rows[source].tolist()[:-1]]
        end = rows.iloc[-1]
        state.update((end["intent"], end["response"]))
        if ttl is not None:
            due = int((end["ts"] + ttl).tz_localize("UTC").timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield rows

    alone = F.concat(F.lit(_PASSING), F.pmod(F.xxhash64("ts", "event_id"), F.lit(_SPREAD)).cast("string"))
    session = F.coalesce(F.nullif(F.col(key), F.lit("")), alone)
    if passing:
        session = F.when(F.col(passing), alone).otherwise(session)
    return (
        turns.withColumn("_session", session)
        .groupBy("_session")
        .applyInPandasWithState(follow, schema, _STATE, "append", timeout)
    )
