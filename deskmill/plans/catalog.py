"""Every registered query: a name and the job behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions import intents
from deskmill.functions.crypto import decrypt_col, derive_key, encrypt_col
from deskmill.functions.pii import mask_pii, pii_entries, unmask
from deskmill.functions.times import iso, naive
from deskmill.operators import availability as av
from deskmill.operators import (
    booking,
    dispatch,
    gates,
    inference,
    resolve,
    sessions,
    tasks,
    turns,
    validate,
)
from deskmill.plans import views
from deskmill.session import fresh_dir
from deskmill.sources import tables
from deskmill.sources.calls import POSTED, read_call_turns
from deskmill.streaming.bookings import stream_bookings
from deskmill.streaming.calls import answer_calls, stream_calls
from deskmill.streaming.masking import stream_pii_mask
from deskmill.streaming.runner import run_available
from deskmill.streaming.sessions import stream_sessions

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {}

# Streams whose job is named apart from the function it wires up.
NAMES = {
    "stream_session_context": "stream_sessions",
    "stream_pii_masking": "stream_pii_mask",
    "stream_booking": "stream_bookings",
    "stream_call_turns": "stream_calls",
}


def query(job: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # A split that costs one more exchange is worth it where one calendar is hot.
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        return job(spark, sf_dir)

    CATALOG[NAMES.get(job.__name__, job.__name__)] = run
    return run


# -- flat forms, for comparison outside Spark --------------------------------


def _conflict_text() -> Column:
    return F.expr("array_join(transform(conflicts, c -> concat(c.id, ':', c.title)), '|')").alias(
        "conflicts"
    )


def _times_text() -> Column:
    return F.array_join(F.transform("suggested_times", iso), "|").alias("suggested_times")


def _ascii_letters(text: Column) -> Column:
    """Letters outside ASCII as ``_``: the comparing engine has ASCII word edges."""
    return F.regexp_replace(text, r"[\p{L}&&[^\x00-\x7F]]", "_")


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: naive(F.col(c)) for c in columns})


# -- calendar ----------------------------------------------------------------


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = views.events(spark, sf_dir)
    return views.requests(ev), views.appointments(ev)


@query
def active_appointments(spark, sf_dir):
    _, appts = _calendar(spark, sf_dir)
    return _naive(av.not_cancelled(appts), "start", "end")


@query
def conflict_pairs(spark, sf_dir):
    return av.conflict_pairs(*_calendar(spark, sf_dir))


@query
def conflict_pairs_stored(spark, sf_dir):
    requests, appointments = _calendar(spark, sf_dir)
    path = fresh_dir(spark, "calendar")
    name = "calendar_" + path[-32:]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    av.save_standing(appointments, name, buckets, path)
    return av.stored_conflict_pairs(requests, name)


@query
def availability_check(spark, sf_dir):
    checked = av.check_availability(*_calendar(spark, sf_dir))
    return checked.select("request_id", "available", _conflict_text())


@query
def suggest_slots(spark, sf_dir):
    return av.suggest_slots(*_calendar(spark, sf_dir)).select("request_id", _times_text())


@query
def availability(spark, sf_dir):
    answered = av.availability(*_calendar(spark, sf_dir))
    return answered.select("request_id", "available", _conflict_text(), _times_text())


def _booking_report(outcome: DataFrame) -> DataFrame:
    return outcome.select("request_id", "success", "appointment_id", "message", _conflict_text())


@query
def book_greedy(spark, sf_dir):
    return _booking_report(booking.book(*_calendar(spark, sf_dir)))


@query
def append_bookings(spark, sf_dir):
    path = fresh_dir(spark, "appointments")
    rows = booking.appointment_rows(booking.accept(*_calendar(spark, sf_dir)))
    tables.append_bookings(rows, path)
    stored = tables.load_appointments(spark, path).withColumn(
        "attendees", tables.attendees_json(F.col("attendees"))
    )
    return _naive(stored, "start", "end", "created_at")


@query
def seed_if_empty(spark, sf_dir):
    """The global rule, on stored hours and on a table without any."""
    stored = (
        views.windows(views.events(spark, sf_dir))
        .groupBy("day_of_week", "start_time", "end_time", "buffer_minutes")
        .agg(F.min("calendar_id").alias("id"))
        .select("id", "day_of_week", "start_time", "end_time", "buffer_minutes")
    )
    filled = tables.seed_if_empty(stored).withColumn("stored", F.lit(True))
    seeded = tables.seed_if_empty(stored.filter("day_of_week > 6")).withColumn("stored", F.lit(False))
    return filled.unionByName(seeded)


@query
def seed_default_windows(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return tables.seed_windows(views.calendars(ev), views.windows(ev))


# -- personal data -----------------------------------------------------------


@query
def pii_mask_documents(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mask_pii(docs, "text").select("doc_id", _ascii_letters(F.col("masked")).alias("masked"))


@query
def pii_mapping_documents(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_entries(mask_pii(docs, "text").select("doc_id", "mapping")).select(
        "doc_id", "position", "placeholder", _ascii_letters(F.col("original")).alias("original")
    )


@query
def pii_mask_conversations(spark, sf_dir):
    said = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return mask_pii(said, "text").select(
        "conv_id", "turn", _ascii_letters(F.col("masked")).alias("masked")
    )


@query
def pii_roundtrip(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mask_pii(docs, "text", literals=True).select(
        "doc_id", unmask(F.col("masked"), F.col("mapping")).alias("text")
    )


@query
def encrypt_roundtrip(spark, sf_dir):
    key = derive_key("correct horse", b"per-table salt")
    docs = views.table(spark, sf_dir, "documents")
    sealed = docs.select("doc_id", encrypt_col(F.col("text"), key).alias("token"))
    return sealed.select("doc_id", decrypt_col(F.col("token"), key).cast("string").alias("text"))


@query
def cloud_outbound(spark, sf_dir):
    docs = views.outbound_input(views.table(spark, sf_dir, "documents"))
    path = fresh_dir(spark, "outbound")
    gates.write_outbound(gates.outbound(docs, "doc_id", "text", {"anthropic"}), path)
    sent = spark.read.schema("doc_id bigint, prompt string, provider string").parquet(path)
    return sent.select("doc_id", "provider", _ascii_letters(F.col("prompt")).alias("prompt"))


# -- intents and dialogue ----------------------------------------------------


def _ruled(turns: DataFrame) -> DataFrame:
    """Utterances with their rule intent and the reply to it."""
    ruled = turns.withColumn("_rule", intents.rule_intent(F.col("text"))).withColumns(
        {
            "intent": F.col("_rule.intent"),
            "confidence": F.col("_rule.confidence"),
            "entities": F.lit(None).cast("map<string,string>"),
        }
    )
    return dispatch.dispatch(ruled.drop("_rule"))


def _dialogue(ev: DataFrame) -> DataFrame:
    return _ruled(views.utterances(ev)).select(
        "request_id", "event_id", "session_id", "ts", "text", "intent", "confidence", "response"
    )


_CONTEXT = ["request_id", "session_id", "intent", "response", "prev_intent", "prev_response"]


@query
def intent_rules(spark, sf_dir):
    return _dialogue(views.events(spark, sf_dir)).select("request_id", "intent", "confidence")


@query
def intent_rules_documents(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", intents.rule_intent(F.col("text")).alias("r")).select(
        "doc_id", "r.intent", "r.confidence"
    )


def _parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = views.model_replies(views.events(spark, sf_dir))
    return intents.parse_replies(replies, "reply").select(
        "request_id", "calendar_id", "arrival", "parsed.*"
    )


@query
def intent_json_extract(spark, sf_dir):
    known = [
        intents.entity(F.col("entities"), name).alias(name)
        for name in ("datetime", "title", "duration")
    ]
    return _parsed_replies(spark, sf_dir).select(
        "request_id", "intent", "confidence", *known, "text", "raw"
    )


@query
def prompt_build(spark, sf_dir):
    followed = sessions.with_previous(
        _dialogue(views.events(spark, sf_dir)),
        "session_id",
        ["ts", "event_id"],
        {"prev_intent": "intent", "prev_confidence": "confidence"},
    )
    previous = intents.rule_repr(F.col("prev_intent"), F.col("prev_confidence"))
    return followed.select(
        "request_id", intents.build_prompt(F.col("text"), previous).alias("prompt")
    )


@query
def session_context(spark, sf_dir):
    return sessions.with_context(_dialogue(views.events(spark, sf_dir))).select(*_CONTEXT)


@query
def dispatch_response(spark, sf_dir):
    return dispatch.dispatch(_parsed_replies(spark, sf_dir)).select(
        "request_id", "intent", "action", "response"
    )


@query
def dispatch_calendar(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    dispatched = dispatch.dispatch(_parsed_replies(spark, sf_dir))
    return dispatch.dispatch_calendar(dispatched, views.appointments(ev))


@query
def resolve_intents(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    local = _ruled(views.utterances(ev))
    resolved = resolve.resolve_intents(local, views.cloud_replies(ev))
    title = intents.entity(F.col("entities"), "title").alias("title")
    return resolved.select("request_id", "intent", "confidence", title, "source")


@query
def transcript_gate(spark, sf_dir):
    heard = gates.gate_transcripts(views.transcripts(views.events(spark, sf_dir)))
    return heard.select("event_id", "text", "error")


@query
def call_turns(spark, sf_dir):
    return _naive(answer_calls(views.call_turns(views.events(spark, sf_dir))), "ts")


@query
def call_turns_landed(spark, sf_dir):
    """Call turns that a webhook posted and that landed as JSON."""
    heard = views.call_turns(views.events(spark, sf_dir))
    path = fresh_dir(spark, "landed")
    posted = heard.withColumnsRenamed(POSTED).write
    posted.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return _naive(answer_calls(read_call_turns(spark, path, posted=True)), "ts")


def _stub_model() -> Callable[[str], str]:
    """Stands in for the caller's model: answers, talks, or fails."""

    def answer(prompt: str) -> str:
        if 'Request: "Hello' in prompt:
            raise RuntimeError("no answer")
        if 'Request: "Are you FREE' in prompt:
            return 'Here: {"intent": "check_availability", "title": "Call"}'
        return "Sorry, say again"

    return answer


@query
def model_infer_fallback(spark, sf_dir):
    heard = views.utterances(views.events(spark, sf_dir)).select("request_id", "text")
    no_context = F.lit(None).cast("string")
    prompts = heard.withColumn("prompt", intents.build_prompt(F.col("text"), no_context))
    answered = inference.intents_with_fallback(inference.infer(prompts, _stub_model))
    title = intents.entity(F.col("entities"), "title").alias("title")
    return answered.select("request_id", "intent", "confidence", title, "origin")


def _local_model() -> Callable[[str], str]:
    """Stands in for the local model of whole turns; some of its answers follow from the turn before."""

    def answer(prompt: str) -> str:
        after_task = prompt.startswith("Previous intent: {'intent': 'create_task'")
        after_booking = prompt.startswith("Previous intent: {'intent': 'book_appointment'")
        if 'Request: "Hello' in prompt and after_task:
            return '{"intent": "create_task", "title": "More"}'
        if 'Request: "Hello' in prompt or 'Request: "Add' in prompt:
            raise RuntimeError("no answer")
        if 'Request: "Are you FREE' in prompt:
            return 'Here: {"intent": "check_availability", "title": "Call"}'
        if 'Request: "Schedule' in prompt:
            return '{"intent": "book_appointment", "datetime": "2024-02-15T10:00:00", "title": "Call"}'
        if 'Request: "Please make' in prompt:
            return '{"intent": "create_task", "title": "%s"}' % ("Follow-up" if after_booking else "Noted")
        return "Sorry, say again"

    return answer


def _cloud_model() -> Callable[[str], str | None]:
    """Stands in for a cloud model: knows what to do with to-do items only."""
    return lambda prompt: "Please make a task of it" if "todo" in prompt else None


@query
def process_text(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return turns.process_text(
        views.turns(ev),
        views.appointments(ev),
        views.tasks(ev).select("task_id"),
        _local_model,
        _cloud_model,
        {"anthropic"},
    )


# -- checks ------------------------------------------------------------------


@query
def validate_booking_requests(spark, sf_dir):
    checked = validate.validate_bookings(views.booking_forms(views.events(spark, sf_dir)))
    return _naive(checked, "start").select(
        "form_id",
        "title",
        "start",
        F.col("duration_minutes").cast("double").alias("duration_minutes"),
        F.array_join("attendees", ",").alias("attendees"),
        "reject_reason",
    )


@query
def validate_availability_requests(spark, sf_dir):
    forms = views.availability_forms(views.events(spark, sf_dir))
    return _naive(validate.validate_availability(forms), "start").select(
        "form_id", "start", "duration_minutes", "reject_reason"
    )


# -- tasks -------------------------------------------------------------------


@query
def task_create(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    made = tasks.create_tasks(views.task_requests(ev), views.tasks(ev), ["ts", "request_id"])
    return made.select("request_id", "task_id", "title", "description", "response")


@query
def image_task_link(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    linked = tasks.link_images(views.analyses(ev), views.tasks(ev))
    return linked.select("analysis_id", "task_id", "title", "completion_status", "error")


@query
def task_progress(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    progress = tasks.task_progress(views.tasks(ev), views.analyses(ev))
    return _naive(progress, "due_date", "updated_at")


@query
def task_timeline(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return _naive(tasks.task_timeline(views.task_events(ev), views.tasks(ev)), "ts")


# -- streams -----------------------------------------------------------------


@query
def stream_session_context(spark, sf_dir):
    followed = stream_sessions(_dialogue(views.event_stream(spark, sf_dir)))
    return run_available(followed, "sessions").select(*_CONTEXT)


@query
def stream_pii_masking(spark, sf_dir):
    docs = (
        spark.readStream.schema(views.table(spark, sf_dir, "documents").schema)
        .option("pathGlobFilter", "documents.parquet")
        .parquet(sf_dir)
        .select("doc_id", "text")
    )
    masked = stream_pii_mask(docs, "text").select("doc_id", "masked")
    return run_available(masked, "masking").select(
        "doc_id", _ascii_letters(F.col("masked")).alias("masked")
    )


@query
def stream_booking(spark, sf_dir):
    wished = views.requests(views.event_stream(spark, sf_dir))
    standing = views.appointments(views.events(spark, sf_dir))
    return _booking_report(stream_bookings(wished, standing))


@query
def stream_call_turns(spark, sf_dir):
    answered = stream_calls(views.call_turns(views.event_stream(spark, sf_dir)))
    return _naive(run_available(answered, "calls"), "ts")
