"""Model calls inside a Spark job. The model is the caller's; none ships here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.intents import parse_replies, rule_intent
from deskmill.session import durable

# What is asked about every image.
QUESTIONS = {
    "description": "Describe this image in detail. What is happening?",
    "task_type": "What type of work or task is shown? (construction, meeting, document, etc.)",
    "completion_status": "Is this work completed or in progress?",
}


def infer(
    df: DataFrame,
    load: Callable[[], Callable],
    prompt: str = "prompt",
    batched: bool = False,
    reply: str = "reply",
) -> DataFrame:
    """Add ``reply``: the model's answer to ``prompt``, NULL where the call raised.

    ``load`` runs once per partition and returns the model call: one prompt to one
    answer or, ``batched``, a list of prompts to a list of answers. A batch that raises is
    asked again prompt by prompt. Answers that are no text are NULL; a NULL prompt is not asked.

    Of a table each distinct prompt is asked once, and its answer is joined back to all rows
    that share it; a prompt with a third of all rows is one call, and a skewed join at most.
    Only the prompts go to Python. The answers are written, so that steps which read them
    several times neither pay for a model call twice nor see two answers to one prompt. On a
    stream every row is asked, since nothing is known of the prompts to come.
    """

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(text: str) -> object:
            try:
                return model([text])[0] if batched else model(text)
            except Exception:  # a failed row falls back, the job goes on
                return None

        def many(texts: list[str]) -> list:
            if batched:
                try:
                    answers = list(model(texts))
                    if len(answers) == len(texts):
                        return answers
                except Exception:  # one bad prompt does not spoil its batch
                    pass
            return [one(text) for text in texts]

        for batch in batches:
            answers = [a if isinstance(a, str) else None for a in many(batch.tolist())]
            yield pd.Series(answers, index=batch.index, dtype=object)

    answer = ask.asNondeterministic()(F.col(prompt))
    if df.isStreaming:
        return df.withColumn(reply, answer)
    distinct = df.select(prompt).filter(F.col(prompt).isNotNull()).distinct()
    return df.join(durable(distinct.withColumn(reply, answer)), prompt, "left").select(*df.columns, reply)


def intents_with_fallback(df: DataFrame, text: str = "text", reply: str = "reply") -> DataFrame:
    """Add ``intent, confidence, entities, origin``: from the reply, else by rule."""
    parsed = parse_replies(df, reply, "_parsed").withColumn("_rule", rule_intent(F.col(text)))
    answered = F.col(reply).isNotNull()
    return parsed.withColumns(
        {
            "intent": F.when(answered, F.col("_parsed.intent")).otherwise(F.col("_rule.intent")),
            "confidence": F.when(answered, F.col("_parsed.confidence")).otherwise(
                F.col("_rule.confidence")
            ),
            "entities": F.when(answered, F.col("_parsed.entities")),
            "origin": F.when(answered, "model").otherwise("rule"),
        }
    ).drop("_parsed", "_rule")


def analyze_images(
    images: DataFrame,
    load: Callable[[], Callable[[bytes, str], str]],
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """Three answers per image, or the ``error`` where the model failed.

    The bytes are read in the tasks that ask and do not appear in the result.
    """
    kept = [f for f in images.schema.fields if f.name != content]
    names = [*QUESTIONS, "error"]
    schema = T.StructType([*kept, *[T.StructField(n, T.StringType()) for n in names]])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def answers(data: bytes) -> dict[str, str | None]:
            try:
                found = {name: model(data, asked) for name, asked in QUESTIONS.items()}
                return {**found, "error": None}
            except Exception as problem:
                return {**dict.fromkeys(QUESTIONS), "error": str(problem)}

        for batch in batches:
            rows = [answers(data) for data in batch[content]]
            found = pd.DataFrame(rows, columns=names, index=batch.index, dtype=object)
            yield pd.concat([batch.drop(columns=[content]), found], axis=1)

    return images.mapInPandas(look, schema)
