"""Landed call turns, as a table or as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from deskmill.schemas import CALL_TURNS

# The names under which a telephony webhook posts a turn.
POSTED = {"call_sid": "CallSid", "from_number": "From", "speech_result": "SpeechResult"}


def read_call_turns(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
    posted: bool = False,
) -> DataFrame:
    """Turns with ``call_sid, ts, event_id, from_number, speech_result``.

    With ``posted``, records hold the names of the webhook and are renamed.
    As a stream, ``max_files_per_trigger`` bounds what one micro-batch, and with it
    the busiest call in it, has to hold.
    """
    reader = spark.readStream if streaming else spark.read
    landed = CALL_TURNS
    if posted:
        landed = T.StructType([T.StructField(POSTED.get(f.name, f.name), f.dataType) for f in landed])
    reader = reader.format(fmt).schema(landed)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).toDF(*CALL_TURNS.names)
