"""A whole turn as one job: from the text a user sends to the reply and the new context."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.intents import KEYWORDS, PROMPT, REPLY_CONFIDENCE, RULE_CONFIDENCE, UNKNOWN_CONFIDENCE, entity
from deskmill.functions.pii import PLACEHOLDER, mask_pii
from deskmill.operators.dispatch import dispatch, dispatch_calendar
from deskmill.operators.gates import ESCALATE_BELOW, choose_provider
from deskmill.operators.inference import intents_with_fallback
from deskmill.operators.sessions import with_context
from deskmill.operators.tasks import create_tasks
from deskmill.session import durable

Load = Callable[[], Callable]

_PLACEHOLDER = re.compile(PLACEHOLDER)
_MEANT = "reply string, heard string, source string, record string, last_record string"


def _prompt(text: str, previous: str | None) -> str:
    line = f"Previous intent: {previous}\n" if previous else ""
    return line + PROMPT.replace("<request>", text)


def _read(reply: str) -> dict:
    """The members of a reply's JSON object; a reply without one is kept as text."""
    first, last = reply.find("{"), reply.rfind("}")
    if first < 0 or last < first:
        return {"intent": "unknown", "text": reply}
    try:
        found = json.loads(reply[first : last + 1])
    except (ValueError, RecursionError):
        return {"intent": "unknown", "raw": reply}
    return found if isinstance(found, dict) else {"intent": "unknown", "raw": reply}


def _rule(text: str | None) -> dict:
    lowered = (text or "").lower()
    for intent, words in KEYWORDS.items():
        if any(word in lowered for word in words):
            return {"intent": intent, "confidence": RULE_CONFIDENCE}
    return {"intent": "unknown", "confidence": UNKNOWN_CONFIDENCE}


def _meant(reply: str | None, heard: str | None) -> dict:
    """The whole intent: what the model replied or, without a reply, what the rules say."""
    return _rule(heard) if reply is None else {**_read(reply), "confidence": REPLY_CONFIDENCE}


class _Asked:
    """A model that answers lists; a call that raises, and an answer that is no text, is None."""

    def __init__(self, model: Callable, batched: bool):
        self.model, self.batched = model, batched

    def _one(self, prompt: str) -> object:
        try:
            return self.model([prompt])[0] if self.batched else self.model(prompt)
        except Exception:  # a failed turn falls back, the job goes on
            return None

    def __call__(self, prompts: list[str]) -> list[str | None]:
        answers = None
        if self.batched and len(prompts) > 1:
            try:
                answers = list(self.model(prompts))
            except Exception:  # one bad prompt does not spoil its wave
                answers = None
        if answers is None or len(answers) != len(prompts):
            answers = [self._one(p) for p in prompts]
        return [a if isinstance(a, str) else None for a in answers]


def _answered(model: _Asked, texts: list[str | None], context: list[str | None]) -> list[str | None]:
    asked = [i for i, t in enumerate(texts) if t is not None]
    out: list[str | None] = [None] * len(texts)
    for i, answer in zip(asked, model([_prompt(texts[i], context[i]) for i in asked]) if asked else []):
        out[i] = answer
    return out


def _wave(
    wave: pd.DataFrame, context: list[str | None], local: _Asked, cloud: _Asked
) -> dict[str, list[str | None]]:
    """What some turns of different sessions mean, given the intent before each."""
    heard: list[str | None] = wave["text"].tolist()
    replies = _answered(local, heard, context)
    meant = [_meant(r, t) for r, t in zip(replies, heard)]
    leave = [
        i
        for i, (masked, m) in enumerate(zip(wave["_masked"].tolist(), meant))
        if masked is not None and m["confidence"] < ESCALATE_BELOW
    ]
    source: list[str | None] = [None] * len(heard)
    masked, mapping = wave["_masked"].tolist(), wave["_mapping"].tolist()
    said = cloud([masked[i] for i in leave]) if leave else []
    back = []
    for i, answer in zip(leave, said):
        if answer:
            originals = dict(mapping[i])
            heard[i] = _PLACEHOLDER.sub(lambda m: originals.get(m[0], m[0]), answer)
            source[i] = "cloud"
            back.append(i)
    for i, reply in zip(back, _answered(local, [heard[i] for i in back], [context[i] for i in back])):
        replies[i] = reply
        meant[i] = {**_meant(reply, heard[i]), "source": "cloud"}
    return {"reply": replies, "heard": heard, "source": source, "record": [str(m) for m in meant]}


def understand(
    turns: DataFrame,
    local: Load,
    cloud: Load,
    configured: Collection[str] = (),
    enabled: bool = True,
    batched: bool = False,
) -> DataFrame:
    """``turns`` with what each means in its session.

    Adds ``reply`` (of the local model, NULL where it failed), ``heard`` (the text or, with
    ``source = 'cloud'``, what the cloud made of it), ``record``, the whole intent as the next
    prompt spells it, and ``last_record``, the one before.

    Every prompt needs the answer to the one before in its session, so turns are asked in
    waves: a task holds some sessions, sorted by the ordinal of the turn, and asks the k-th
    turns of all of them (one call where the model is ``batched``) with the records of the
    wave before. A session that outlasts the others goes on alone. A task keeps one record
    per session that has a turn to come; turns without a session are sessions of one turn.

    With ``batched`` both models take and give lists. The cloud sees masked texts only, of turns that want it, may leave, and got a low
    confidence. Placeholders in its answer are put back before the local model reads it, with
    the same context.
    """
    may_leave = F.coalesce(F.col("use_cloud"), F.lit(False)) & F.coalesce(F.col("user_consent"), F.lit(False))
    if not enabled:
        may_leave = F.lit(False)
    may_leave = may_leave & choose_provider(configured).isNotNull()
    masked = mask_pii(turns.withColumn("_leaves", F.when(may_leave, F.col("text"))), "_leaves", "_masked", "_mapped", literals=True)
    session = F.nullif(F.col("session_id"), F.lit(""))
    # a turn without a session is dealt by its id, and so never to one task with all others
    alone = F.concat(F.lit("\x00"), F.col("request_id").cast("string"))
    in_session = Window.partitionBy("_session").orderBy("ts", "event_id")
    waves = (
        masked.withColumn("_session", F.coalesce(session, alone))
        .withColumn("_turn", F.row_number().over(in_session))
        .withColumn("_ends", F.lead(F.lit(False), 1, True).over(in_session))
        .withColumn("_mapping", F.transform(F.map_entries("_mapped"), lambda e: F.array(e["key"], e["value"])))
        .select(*turns.columns, "_session", "_turn", "_ends", "_masked", "_mapping")
        .sortWithinPartitions("_turn", "_session")
    )
    schema = T.StructType([*turns.schema.fields, *T.StructType.fromDDL(_MEANT).fields])
    columns = turns.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, outside = _Asked(local(), batched), _Asked(cloud(), batched)
        records: dict[str, str] = {}
        for batch in batches:
            # rows of one ordinal belong to different sessions
            for _, wave in batch.groupby("_turn", sort=False):
                sessions = wave["_session"].tolist()
                context = [records.pop(s, None) for s in sessions]
                found = _wave(wave, context, asked, outside)
                for s, record, ends in zip(sessions, found["record"], wave["_ends"].tolist()):
                    if not ends:
                        records[s] = record
                rows = wave[columns].copy()
                for name, values in {**found, "last_record": context}.items():
                    rows[name] = pd.Series(values, index=rows.index, dtype=object)
                yield rows

    # models are asked once: all later steps read what was written
    return durable(waves.mapInPandas(run, schema))


def process_text(
    turns: DataFrame,
    appointments: DataFrame,
    tasks: DataFrame,
    local: Load,
    cloud: Load,
    configured: Collection[str] = (),
    enabled: bool = True,
    batched: bool = False,
) -> DataFrame:
    """Replies to ``turns``, with their intent, its source, and the context they met.

    Needs ``request_id, event_id, calendar_id, session_id, ts, text, use_cloud, user_consent``.
    The local model reads every text, led by the whole intent of the turn before
    (:func:`understand`); where it fails the rules decide. Calendar and task replies are those
    of all turns served in order of time. ``last_intent`` and ``last_response`` are those of
    the turn before.
    """
    meant = understand(turns, local, cloud, configured, enabled, batched)
    served = durable(dispatch(intents_with_fallback(meant, "heard")))

    calendar = dispatch_calendar(served.withColumn("arrival", F.col("ts")), appointments)
    titled = served.filter("action = 'task'").select(
        "request_id", "ts", entity(F.col("entities"), "title").alias("title")
    )
    made = create_tasks(titled, tasks, ["ts", "request_id"])
    replies = calendar.select("request_id", F.col("response").alias("_done")).unionByName(
        made.select("request_id", F.col("response").alias("_done"))
    )
    answered = (
        served.join(replies, "request_id", "left")
        .withColumn("response", F.coalesce("_done", "response"))
        .select(
            "request_id", "event_id", "session_id", "ts", "confidence", "source", "response",
            "intent", "last_record",
        )
    )
    return with_context(answered).select(
        "request_id",
        "session_id",
        "intent",
        "confidence",
        "source",
        "response",
        F.col("last_record").alias("last_intent"),
        F.col("prev_response").alias("last_response"),
    )
