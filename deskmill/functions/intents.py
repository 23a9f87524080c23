"""Intent rules, strict reading of model replies, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords per intent, the confidences, and the prompt text.
KEYWORDS = {
    "check_availability": ("available", "free"),
    "book_appointment": ("book", "schedule"),
    "create_task": ("task", "todo"),
}
RULE_CONFIDENCE = 0.5
UNKNOWN_CONFIDENCE = 0.3
REPLY_CONFIDENCE = 0.8
PROMPT = """Analyze the user request and output JSON with intent and entities.
Possible intents: check_availability, book_appointment, create_task, cancel_appointment, unknown.

Request: "<request>"

JSON output:
{
    "intent": "check_availability",
    "datetime": "2025-03-01T15:00:00",
    "duration_minutes": 60,
    "attendees": ["john@example.com"],
    "title": "Meeting with John"
}
"""

_ENTITIES = "map<string,string>"


def rule_intent(text: Column) -> Column:
    """``struct(intent, confidence)`` by the first keyword group that occurs."""
    lowered = F.lower(text)
    name = None
    for intent, words in KEYWORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        name = F.when(hit, intent) if name is None else name.when(hit, intent)
    name = name.otherwise("unknown")
    confidence = F.when(name == "unknown", UNKNOWN_CONFIDENCE).otherwise(RULE_CONFIDENCE)
    return F.struct(name.alias("intent"), confidence.alias("confidence"))


def rule_repr(intent: Column, confidence: Column) -> Column:
    """How a rule intent is spelled on a prompt's context line."""
    return F.concat(
        F.lit("{'intent': '"), intent, F.lit("', 'confidence': "), confidence.cast("string"), F.lit("}")
    )


def reply_object(reply: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, NULL when there is none."""
    first = F.instr(reply, "{")
    last = F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    inside = (first > 0) & (F.instr(reply, "}") > 0) & (last > first)
    return F.when(inside, F.substring(reply, first, last - first + 1))


def with_json_object(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the members of exactly one JSON object as text, NULL for anything else.

    Wrapping in brackets makes trailing data visible: the parser itself would
    stop after the first value and ignore the rest. Of equal keys the last counts.
    Parsing is a column of its own, so that it happens once.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), text, F.lit("]")),
        f"array<{_ENTITIES}>",
        {"allowSingleQuotes": "false"},
    )
    last_of_equal = """map_from_arrays(array_distinct(map_keys(_members)),
        transform(array_distinct(map_keys(_members)),
            name -> element_at(filter(map_entries(_members), e -> e.key = name), -1).value))"""
    return (
        df.withColumn("_wrapped", wrapped)
        .withColumn("_members", F.expr("CASE WHEN size(_wrapped) = 1 THEN get(_wrapped, 0) END"))
        .withColumn(
            out,
            F.expr(
                f"""CASE WHEN size(array_distinct(map_keys(_members))) < size(_members)
                    THEN {last_of_equal} ELSE _members END"""
            ),
        )
        .drop("_wrapped", "_members")
    )


def entity(entities: Column, name: str) -> Column:
    """One entity as text; NULL when missing or JSON null."""
    return F.try_element_at(entities, F.lit(name))


def parse_replies(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """Add ``struct(intent, confidence, entities, text, raw)`` of a model reply.

    Without braces the reply is kept as ``text``, with a broken object as ``raw``.
    Entity values are JSON text, so known keys are cast where they are used. The
    steps are separate columns so that each reply is parsed once.
    """
    reply, found, entities = F.col(column), F.col("_object"), F.col("_entities")
    broken = found.isNotNull() & entities.isNull()
    parsed = with_json_object(df.withColumn("_object", reply_object(reply)), found, "_entities")
    return parsed.withColumn(
        out,
        F.struct(
            F.when(entities.isNull(), "unknown")
            .otherwise(entity(entities, "intent"))
            .alias("intent"),
            F.lit(REPLY_CONFIDENCE).alias("confidence"),
            entities.alias("entities"),
            F.when(found.isNull(), reply).alias("text"),
            F.when(broken, reply).alias("raw"),
        ),
    ).drop("_object", "_entities")


def build_prompt(text: Column, previous: Column) -> Column:
    """Model prompt, led by the previous intent of the session where there is one."""
    before, after = PROMPT.split("<request>")
    context = F.when(
        previous.isNotNull() & (previous != ""),
        F.concat(F.lit("Previous intent: "), previous, F.lit("\n")),
    ).otherwise("")
    return F.concat(context, F.lit(before), text, F.lit(after))
