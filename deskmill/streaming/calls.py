"""Phone dialogues: silent turns, intents, replies, context."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.intents import rule_intent
from deskmill.functions.text import is_silent
from deskmill.operators.dispatch import dispatch
from deskmill.operators.gates import REPROMPT, split_silent
from deskmill.operators.sessions import with_context
from deskmill.streaming.sessions import stream_sessions

_COLUMNS = ["call_sid", "ts", "event_id", "reply", "intent", "prev_intent"]


def _understood(spoken: DataFrame) -> DataFrame:
    ruled = spoken.select(
        "call_sid", "ts", "event_id", rule_intent(F.col("speech_result"))["intent"].alias("intent")
    ).withColumn("entities", F.lit(None).cast("map<string,string>"))
    return dispatch(ruled).select("call_sid", "ts", "event_id", "intent", "response")


def _answered(followed: DataFrame, silent: DataFrame) -> DataFrame:
    mute = silent.select(
        "call_sid",
        "ts",
        "event_id",
        "reply",
        F.lit(None).cast("string").alias("intent"),
        F.lit(None).cast("string").alias("prev_intent"),
    )
    return followed.withColumnRenamed("response", "reply").select(*_COLUMNS).unionByName(mute)


def answer_calls(turns: DataFrame) -> DataFrame:
    """Reply per turn of a table of calls; the call id is the session.

    A silent turn gets the reprompt and leaves the context alone.
    """
    silent, spoken = split_silent(turns)
    followed = with_context(_understood(spoken).withColumn("session_id", F.col("call_sid")))
    return _answered(followed, silent)


def stream_calls(turns: DataFrame, ttl: timedelta | None = None) -> DataFrame:
    """``answer_calls`` over a stream of turns, in one pass: silent turns pass by the state."""
    heard = turns.withColumn("_silent", is_silent(F.col("speech_result")))
    spoken = rule_intent(F.col("speech_result"))["intent"]
    ruled = heard.withColumns(
        {"intent": F.when(~F.col("_silent"), spoken), "entities": F.lit(None).cast("map<string,string>")}
    )
    answered = dispatch(ruled).select(
        "call_sid", "ts", "event_id", "intent", "_silent",
        F.when(F.col("_silent"), REPROMPT).otherwise(F.col("response")).alias("response"),
    )
    followed = stream_sessions(answered, "call_sid", ttl, passing="_silent")
    return followed.withColumnRenamed("response", "reply").select(*_COLUMNS)
