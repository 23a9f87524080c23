"""The registered queries once more, in SQL over the given tables.

Written from the rules, not from the Spark jobs, for an engine that knows none of
them. Views restate ``views.py``.
"""

from __future__ import annotations

HOUR = "date_trunc('hour', ts)"

TEXT = """CASE event_type WHEN 'click' THEN 'Are you FREE then?'
    WHEN 'view' THEN 'Please book a room' WHEN 'signup' THEN 'Add a todo item'
    WHEN 'purchase' THEN 'Schedule it if available' ELSE 'Hello there' END"""


def _consent(key: str) -> str:
    return f"CASE {key} % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END"


_MOMENT = f"""CASE WHEN event_id % 11 = 0 THEN 'next Tuesday'
    ELSE strftime({HOUR} + INTERVAL 26 HOURS, '%Y-%m-%dT%H:%M:%S') END"""


def _reply(variant: str) -> str:
    return f"""CASE {variant}
    WHEN 0 THEN 'I could not find anything.'
    WHEN 1 THEN '{{"intent": "check_availability", "datetime": "' || {_MOMENT} || '"}}'
    WHEN 2 THEN 'Sure: {{"intent": "book_appointment", "datetime": "' || {_MOMENT}
        || '", "title": "Visit ' || event_id || '"}} as you wished'
    WHEN 3 THEN '{{"intent": "create_task", "title": "A"}} {{"b": 2}}'
    WHEN 4 THEN '{{''intent'': ''unknown''}}'
    WHEN 5 THEN '{{' || chr(10) || '  "intent": "create_task",' || chr(10)
        || '  "title": "Task ' || event_id || '"' || chr(10) || '}}'
    WHEN 6 THEN '{{"intent": "cancel_appointment", "confidence": 0.99}}'
    WHEN 7 THEN '{{"intent": "check_availability", "datetime": "' || {_MOMENT}
        || '", "duration": ' || CASE event_id % 5 WHEN 0 THEN '999999999999' WHEN 1 THEN '-30'
            WHEN 2 THEN '22.5' ELSE '90' END || ', "duration_minutes": 30}}'
    ELSE '{{"intent": "book_appointment"' END"""


_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_SPACED = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(ts, '%Y-%m-%d')"

VIEWS = {
    "appointments": f"""SELECT event_id AS id, user_id AS calendar_id,
        event_type || ' #' || event_id AS title, {HOUR} AS s,
        {HOUR} + to_minutes(30 * (event_id % 17)) AS e,
        CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'view' THEN NULL
            ELSE 'confirmed' END AS status
        FROM events""",
    "active": "SELECT * FROM appointments WHERE status <> 'cancelled'",
    "requests": f"""SELECT event_id AS request_id, user_id AS calendar_id, ts AS arrival,
        'Visit ' || event_id AS title, {HOUR} + INTERVAL 26 HOURS AS s,
        {HOUR} + INTERVAL 26 HOURS + to_minutes(30 * (event_id % 19) - 30) AS e,
        CASE WHEN event_id % 4 <> 0 THEN '["user' || user_id || '@example.com"]'
            ELSE '[]' END AS attendees
        FROM events""",
    "utterances": f"""SELECT event_id AS request_id, event_id,
        CASE WHEN event_id % 11 <> 0 THEN user_id::VARCHAR END AS session_id, ts,
        {TEXT} AS text, event_id % 2 = 0 AS use_cloud
        FROM events""",
    "ruled": """SELECT *,
        CASE WHEN intent = 'unknown' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
        CASE intent WHEN 'check_availability'
                THEN 'I need a date and time to check availability.'
            WHEN 'unknown' THEN 'I''m not sure how to help with that. Can you rephrase?'
            ELSE 'I didn''t get all the details. Please provide more information.' END AS response
        FROM (SELECT *,
            CASE WHEN contains(lower(text), 'available') OR contains(lower(text), 'free')
                    THEN 'check_availability'
                WHEN contains(lower(text), 'book') OR contains(lower(text), 'schedule')
                    THEN 'book_appointment'
                WHEN contains(lower(text), 'task') OR contains(lower(text), 'todo')
                    THEN 'create_task'
                ELSE 'unknown' END AS intent
            FROM utterances)""",
    "call_turns": f"""SELECT 'CA' || user_id AS call_sid, ts, event_id,
        CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
            ELSE {TEXT} END AS speech_result
        FROM events""",
    "transcripts": f"""SELECT event_id, chr(160) || chr(9)
        || CASE WHEN event_id % 10 = 0 THEN '' ELSE {TEXT} END || ' ' || chr(10) AS transcript
        FROM events""",
    "booking_forms": f"""SELECT event_id AS form_id, '{{"note": 1'
        || CASE WHEN event_id % 8 = 0 THEN '' ELSE ', "title": "'
            || CASE WHEN event_id % 8 = 3 THEN '' ELSE 'Visit ' || event_id END || '"' END
        || CASE WHEN event_id % 8 = 1 THEN '' ELSE ', "start_datetime": "'
            || CASE event_id % 8 WHEN 2 THEN '2024-13-01T10:00:00' WHEN 4 THEN {_DAY}
                WHEN 7 THEN {_SPACED} ELSE {_TIME} END || '"' END
        || CASE WHEN event_id % 8 = 5 THEN '' ELSE ', "duration": '
            || CASE WHEN event_id % 7 = 3 THEN '45.5' ELSE (15 * (event_id % 7))::VARCHAR END END
        || CASE WHEN event_id % 8 = 6
            THEN ', "attendees": ["a' || user_id || '@example.com", "b@example.com"]' ELSE '' END
        || '}}' AS payload
        FROM events""",
    "availability_forms": f"""SELECT event_id AS form_id,
        CASE event_id % 8 WHEN 2 THEN '2024-13-01T10:00:00' WHEN 3 THEN 'next week'
            WHEN 4 THEN {_DAY} WHEN 5 THEN {_TIME} || 'Z' WHEN 7 THEN {_SPACED}
            ELSE {_TIME} END AS datetime_str,
        CASE WHEN event_id % 5 <> 0 THEN (15 * (event_id % 7))::INTEGER END AS duration
        FROM events""",
    "model_replies": f"""SELECT event_id AS request_id, user_id AS calendar_id, ts AS arrival,
        {_reply('event_id % 9')} AS reply FROM events""",
    "cloud_replies": f"""SELECT event_id AS request_id, {_reply('(event_id + 1) % 9')} AS reply
        FROM events WHERE event_type IN ('click', 'error', 'view')""",
    "tasks": """SELECT user_id AS task_id, 'Task ' || user_id AS title,
        min(ts) + INTERVAL 7 DAYS AS due_date
        FROM events WHERE event_type = 'signup' GROUP BY user_id""",
    "analyses": """SELECT event_id AS analysis_id, ts,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 10 = 3 THEN 0
            ELSE user_id END AS task_id,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2 = 0 THEN 'completed'
            ELSE 'in progress' END AS completion_status,
        CASE WHEN event_type = 'error' THEN 'model not loaded' END AS error
        FROM events""",
}


def _parsed(replies: str) -> str:
    """Replies with the strictly read JSON object ``o``, NULL when there is none."""
    return f"""SELECT *, CASE WHEN j <> '' AND json_valid(j) THEN j END AS o
        FROM (SELECT *, regexp_extract(reply, '\\{{(.|\\n)*\\}}') AS j FROM {replies})"""


def _clash(s: str, e: str, start: str, end: str) -> str:
    return f"(({s} < {end} AND {e} > {start}) OR ({s} >= {start} AND {e} <= {end}))"


def _iso(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S')"


def _greedy(wished: str) -> dict[str, str]:
    """Views that book ``wished`` one after the other, per calendar."""
    hit = _clash("a.s", "a.e", "r.s", "r.e")
    return {
        "queue": f"""SELECT r.*, row_number() OVER (PARTITION BY calendar_id
                ORDER BY arrival, request_id) AS turn,
            EXISTS (SELECT 1 FROM active a WHERE a.calendar_id = r.calendar_id AND {hit}) AS blocked
            FROM {wished} r""",
        "walk": f"""SELECT DISTINCT calendar_id, 0::BIGINT AS turn,
                []::STRUCT(id BIGINT, s TIMESTAMP, e TIMESTAMP)[] AS won FROM queue
            UNION ALL
            SELECT w.calendar_id, r.turn,
                CASE WHEN r.blocked OR len(list_filter(w.won, lambda a: {hit})) > 0 THEN w.won
                    ELSE list_append(w.won, {{'id': r.request_id, 's': r.s, 'e': r.e}}) END
            FROM walk w JOIN queue r
                ON r.calendar_id = w.calendar_id AND r.turn = w.turn + 1""",
        "winners": """SELECT unnest(won).id AS request_id FROM
            (SELECT calendar_id, arg_max(won, turn) AS won FROM walk GROUP BY calendar_id)""",
        "accepted": f"""SELECT r.*, (SELECT max(id) FROM appointments)
                + row_number() OVER (ORDER BY arrival, request_id) AS appointment_id
            FROM {wished} r WHERE request_id IN (SELECT request_id FROM winners)""",
        "standing": """SELECT id, calendar_id, title, s, e, NULL::TIMESTAMP AS since,
                NULL::BIGINT AS since_id FROM active
            UNION ALL
            SELECT appointment_id, calendar_id, title, s, e, arrival, request_id FROM accepted""",
    }


_SEEN = """(a.since IS NULL OR a.since < r.arrival
    OR (a.since = r.arrival AND a.since_id < r.request_id))"""


def _sql(body: str, *names: str, **more: str) -> str:
    """``body`` under a WITH clause of the named views and of ``more``."""
    shared = [f"{name} AS ({VIEWS[name]})" for name in names]
    own = [f"{name} AS ({text})" for name, text in more.items()]
    clause = ",\n".join(shared + own)
    return f"WITH RECURSIVE {clause}\n{body}" if clause else body


_CALENDAR = ("appointments", "active", "requests")

_PAIRS = f"""SELECT r.request_id, a.id, a.title FROM requests r JOIN active a
    ON a.calendar_id = r.calendar_id AND {_clash('a.s', 'a.e', 'r.s', 'r.e')}"""

_LISTS = """SELECT request_id, string_agg(id || ':' || title, '|' ORDER BY id) AS conflicts
    FROM pairs GROUP BY request_id"""


def _slots(wished: str, busy: str, seen: str = "true") -> dict[str, str]:
    """Views with the first three free hours of the conflicting ``wished`` rows."""
    return {
        "hours": f"""SELECT r.request_id, r.calendar_id, r.arrival, k.k,
            r.s + to_hours(k.k) AS s, r.e + to_hours(k.k) AS e
            FROM {wished} r, (SELECT unnest(range(1, 168)) AS k) k
            WHERE r.request_id IN (SELECT request_id FROM pairs)""",
        "free": f"""SELECT request_id, k, s FROM hours r WHERE NOT EXISTS (
            SELECT 1 FROM {busy} a WHERE a.calendar_id = r.calendar_id
                AND a.s < r.e AND a.e > r.s AND {seen})
            QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY k) <= 3""",
        "suggestions": f"""SELECT p.request_id,
            coalesce(string_agg({_iso('f.s')}, '|' ORDER BY f.k), '') AS suggested_times
            FROM (SELECT DISTINCT request_id FROM pairs) p
            LEFT JOIN free f ON f.request_id = p.request_id GROUP BY p.request_id""",
    }


_BOOK_REPORT = """SELECT r.request_id, a.appointment_id IS NOT NULL AS success, a.appointment_id,
    CASE WHEN a.appointment_id IS NULL THEN 'Slot not available'
        ELSE 'Booked for ' || strftime(r.s, '%B %d at %I:%M %p') END AS message,
    coalesce(l.conflicts, '') AS conflicts
    FROM requests r LEFT JOIN accepted a ON a.request_id = r.request_id
    LEFT JOIN lists l ON l.request_id = r.request_id"""

_BOOK = _sql(
    _BOOK_REPORT,
    *_CALENDAR,
    **_greedy("requests"),
    pairs=f"""SELECT r.request_id, a.id, a.title FROM requests r JOIN standing a
        ON a.calendar_id = r.calendar_id AND {_clash('a.s', 'a.e', 'r.s', 'r.e')} AND {_SEEN}
        WHERE r.request_id NOT IN (SELECT request_id FROM accepted)""",
    lists=_LISTS,
)

# -- masking -----------------------------------------------------------------

# The kinds of personal data.
_KINDS = {
    "EMAIL": r"\b[\w\.-]+@[\w\.-]+\.\w+\b",
    "PHONE": r"\b\+?[\d\-\(\)]{10,}\b",
    "NAME": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
}


def _masking(source: str, keys: str) -> dict[str, str]:
    """Views ``m0 .. m3``, each masking one more kind of ``text``.

    Letters outside ASCII become ``_`` beforehand: word edges are ASCII here.
    """
    steps = {
        "m0": f"""SELECT {keys}, regexp_replace(text, '[^\\x00-\\x7F\\P{{L}}]', '_', 'g') AS t,
            []::VARCHAR[] AS ks, []::VARCHAR[] AS vs FROM {source}"""
    }
    for n, (kind, pattern) in enumerate(_KINDS.items()):
        steps[f"f{n}"] = f"""SELECT {keys}, t, ks, vs, regexp_extract_all(t, '{pattern}') AS hits,
            regexp_split_to_array(t, '{pattern}') AS pieces FROM m{n}"""
        steps[f"k{n}"] = f"""SELECT {keys}, ks, vs, hits, pieces,
            list_transform(hits, lambda h, i: '[{kind}_' || (len(ks) + i - 1) || ']') AS made
            FROM f{n}"""
        steps[f"m{n + 1}"] = f"""SELECT {keys}, array_to_string(list_transform(pieces,
            lambda p, i: p || coalesce(made[i], '')), '') AS t,
            list_concat(ks, made) AS ks, list_concat(vs, hits) AS vs FROM k{n}"""
    return steps


# -- dialogue ----------------------------------------------------------------

_CONTEXT = """SELECT request_id, session_id, intent, response,
    CASE WHEN session_id IS NOT NULL
        THEN lag(intent) OVER (PARTITION BY session_id ORDER BY ts, event_id) END AS prev_intent,
    CASE WHEN session_id IS NOT NULL
        THEN lag(response) OVER (PARTITION BY session_id ORDER BY ts, event_id) END AS prev_response
    FROM ruled"""

_CALLS = """SELECT call_sid, ts, event_id, response AS reply, intent,
    lag(intent) OVER (PARTITION BY call_sid ORDER BY ts, event_id) AS prev_intent FROM ruled
    UNION ALL
    SELECT call_sid, ts, event_id, 'I didn''t catch that. Could you repeat?', NULL, NULL
    FROM call_turns WHERE speech_result IS NULL OR speech_result = ''"""

_SPOKEN = """SELECT call_sid, ts, event_id, speech_result AS text FROM call_turns
    WHERE speech_result <> ''"""

_CALL_TURNS = _sql(_CALLS, "call_turns", utterances=_SPOKEN, ruled=VIEWS["ruled"])

# Fixed value: the prompt. The replies in the views above are fixed as well.
_PROMPT = """'Analyze the user request and output JSON with intent and entities.
Possible intents: check_availability, book_appointment, create_task, cancel_appointment, unknown.

Request: "' || text || '"

JSON output:
{
    "intent": "check_availability",
    "datetime": "2025-03-01T15:00:00",
    "duration_minutes": 60,
    "attendees": ["john@example.com"],
    "title": "Meeting with John"
}
'"""


def _key(name: str) -> str:
    return f"json_extract_string(o, '$.{name}')"


def _has(name: str) -> str:
    return f"coalesce(list_contains(json_keys(o), '{name}'), false)"


_INTENT = f"CASE WHEN o IS NULL THEN 'unknown' ELSE {_key('intent')} END"

_DISPATCHED = f"""SELECT *,
    CASE WHEN intent = 'check_availability' AND coalesce({_key('datetime')}, '') <> '' THEN 'check'
        WHEN intent = 'book_appointment' AND {_has('datetime')} THEN 'book'
        WHEN intent = 'create_task' AND {_has('title')} THEN 'task' END AS action,
    CASE WHEN intent = 'check_availability' THEN
            CASE WHEN coalesce({_key('datetime')}, '') = ''
                THEN 'I need a date and time to check availability.' END
        WHEN intent IN ('book_appointment', 'create_task') THEN
            CASE WHEN NOT CASE intent WHEN 'create_task' THEN {_has('title')}
                    ELSE {_has('datetime')} END
                THEN 'I didn''t get all the details. Please provide more information.' END
        ELSE 'I''m not sure how to help with that. Can you rephrase?' END AS response
    FROM (SELECT *, {_INTENT} AS intent FROM parsed)"""

_ASKED = f"""SELECT request_id, calendar_id, arrival, action, {_key('datetime')} AS asked,
    CASE WHEN minutes < 1000000000 THEN try_cast({_key('datetime')} AS TIMESTAMP) END AS s,
    CASE WHEN minutes < 1000000000 THEN try_cast({_key('datetime')} AS TIMESTAMP)
        + to_microseconds((minutes * 60000000)::BIGINT) END AS e,
    coalesce({_key('title')}, 'Appointment') AS title
    FROM (SELECT *, coalesce({_key('duration')}::DECIMAL(18, 6), 60) AS minutes
        FROM dispatched WHERE action IN ('check', 'book'))"""

_CALENDAR_REPLIES = _sql(
    """SELECT r.request_id, r.action,
        CASE WHEN r.s IS NULL THEN 'Sorry, I encountered an error processing your request.'
        WHEN r.action = 'book' THEN CASE WHEN b.request_id IS NULL THEN 'Slot not available'
            ELSE 'Booked for ' || strftime(r.s, '%B %d at %I:%M %p') END
        WHEN g.request_id IS NULL
            THEN 'Yes, ' || r.asked || ' is available. Would you like to book it?'
        WHEN g.suggested_times <> '' THEN 'That time is not available. How about '
            || split_part(g.suggested_times, '|', 1) || '?'
        ELSE 'Sorry, no availability around that time.' END AS response
    FROM asked r LEFT JOIN accepted b ON b.request_id = r.request_id
    LEFT JOIN suggestions g ON g.request_id = r.request_id""",
    "appointments",
    "active",
    "model_replies",
    parsed=_parsed("model_replies"),
    dispatched=_DISPATCHED,
    asked=_ASKED,
    bookings="SELECT * FROM asked WHERE action = 'book' AND s IS NOT NULL",
    checks="SELECT * FROM asked WHERE action = 'check' AND s IS NOT NULL",
    **_greedy("bookings"),
    pairs=f"""SELECT r.request_id FROM checks r JOIN standing a ON a.calendar_id = r.calendar_id
        AND {_clash('a.s', 'a.e', 'r.s', 'r.e')} AND {_SEEN}""",
    **_slots("checks", "standing", _SEEN),
)

ORACLE = {
    "active_appointments": _sql(
        'SELECT id, calendar_id, title, s AS "start", e AS "end", status FROM active',
        "appointments",
        "active",
    ),
    "conflict_pairs": _sql(_PAIRS, *_CALENDAR),
    "conflict_pairs_stored": _sql(_PAIRS, *_CALENDAR),
    "availability_check": _sql(
        """SELECT r.request_id, l.conflicts IS NULL AS available,
            coalesce(l.conflicts, '') AS conflicts
        FROM requests r LEFT JOIN lists l ON l.request_id = r.request_id""",
        *_CALENDAR,
        pairs=_PAIRS,
        lists=_LISTS,
    ),
    "suggest_slots": _sql(
        "SELECT request_id, suggested_times FROM suggestions",
        *_CALENDAR,
        pairs=_PAIRS,
        **_slots("requests", "active"),
    ),
    "availability": _sql(
        """SELECT r.request_id, l.conflicts IS NULL AS available,
            coalesce(l.conflicts, '') AS conflicts,
            coalesce(g.suggested_times, '') AS suggested_times
        FROM requests r LEFT JOIN lists l ON l.request_id = r.request_id
        LEFT JOIN suggestions g ON g.request_id = r.request_id""",
        *_CALENDAR,
        pairs=_PAIRS,
        lists=_LISTS,
        **_slots("requests", "active"),
    ),
    "book_greedy": _BOOK,
    "stream_bookings": _BOOK,
    "append_bookings": _sql(
        """SELECT appointment_id AS id, calendar_id, title, '' AS description, s AS "start",
            e AS "end", attendees, 'confirmed' AS status, arrival AS created_at,
            NULL::BIGINT AS call_log_id, 'system' AS created_by FROM accepted""",
        *_CALENDAR,
        **_greedy("requests"),
    ),
    "seed_if_empty": _sql(
        """SELECT id, day_of_week, start_time, end_time, buffer_minutes, true AS stored FROM hours
        UNION ALL
        SELECT d.d + 1, d.d::INTEGER, '09:00', '17:00', 15, false
        FROM (SELECT unnest(range(5)) AS d) d""",
        hours="""SELECT min(user_id) AS id, (isodow(ts) - 1)::INTEGER AS day_of_week,
            '08:00' AS start_time, '16:00' AS end_time, 10 AS buffer_minutes
            FROM events WHERE event_type = 'signup' GROUP BY ALL""",
    ),
    "seed_default_windows": _sql(
        """SELECT * FROM windows UNION ALL
        SELECT c.calendar_id, d.day_of_week::INTEGER, '09:00', '17:00', 15
        FROM (SELECT DISTINCT user_id AS calendar_id FROM events) c,
            (SELECT unnest(range(5)) AS day_of_week) d
        WHERE c.calendar_id NOT IN (SELECT calendar_id FROM windows)""",
        windows="""SELECT DISTINCT user_id AS calendar_id,
            (isodow(ts) - 1)::INTEGER AS day_of_week, '08:00' AS start_time,
            '16:00' AS end_time, 10 AS buffer_minutes
            FROM events WHERE event_type = 'signup'""",
    ),
    "pii_mask_documents": _sql(
        "SELECT doc_id, t AS masked FROM m3", **_masking("documents", "doc_id")
    ),
    "stream_pii_mask": _sql(
        "SELECT doc_id, t AS masked FROM m3", **_masking("documents", "doc_id")
    ),
    "pii_mask_conversations": _sql(
        "SELECT conv_id, turn, t AS masked FROM m3", **_masking("conversations", "conv_id, turn")
    ),
    "pii_mapping_documents": _sql(
        """SELECT doc_id, (i - 1)::INTEGER AS position, ks[i] AS placeholder, vs[i] AS original
        FROM (SELECT doc_id, ks, vs, unnest(range(1, len(ks) + 1)) AS i FROM m3)""",
        **_masking("documents", "doc_id"),
    ),
    "pii_roundtrip": "SELECT doc_id, text FROM documents",
    "encrypt_roundtrip": "SELECT doc_id, text FROM documents",
    "cloud_outbound": _sql(
        "SELECT doc_id, 'anthropic' AS provider, t AS prompt FROM m3",
        sent=f"""SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0
            AND coalesce(CASE doc_id % 3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 END, 1.0) < 0.7
            AND coalesce({_consent('doc_id')}, false)""",
        **_masking("sent", "doc_id"),
    ),
    "intent_rules": _sql(
        "SELECT request_id, intent, confidence FROM ruled", "utterances", "ruled"
    ),
    "intent_rules_documents": _sql(
        "SELECT doc_id, intent, confidence FROM ruled",
        utterances="SELECT doc_id, text FROM documents",
        ruled=VIEWS["ruled"],
    ),
    "intent_json_extract": _sql(
        f"""SELECT request_id, {_INTENT} AS intent, 0.8::DOUBLE AS confidence,
            {_key('datetime')} AS datetime, {_key('title')} AS title,
            {_key('duration')} AS duration,
            CASE WHEN j = '' THEN reply END AS text,
            CASE WHEN j <> '' AND o IS NULL THEN reply END AS raw FROM parsed""",
        "model_replies",
        parsed=_parsed("model_replies"),
    ),
    "prompt_build": _sql(
        f"""SELECT request_id, CASE WHEN prev IS NULL THEN '' ELSE 'Previous intent: '
            || prev || chr(10) END || {_PROMPT} AS prompt
        FROM (SELECT *, CASE WHEN session_id IS NOT NULL THEN lag('{{''intent'': ''' || intent
            || ''', ''confidence'': ' || confidence || '}}')
            OVER (PARTITION BY session_id ORDER BY ts, event_id) END AS prev FROM ruled)""",
        "utterances",
        "ruled",
    ),
    "session_context": _sql(_CONTEXT, "utterances", "ruled"),
    "stream_sessions": _sql(_CONTEXT, "utterances", "ruled"),
    "dispatch_response": _sql(
        "SELECT request_id, intent, action, response FROM dispatched",
        "model_replies",
        parsed=_parsed("model_replies"),
        dispatched=_DISPATCHED,
    ),
    "dispatch_calendar": _CALENDAR_REPLIES,
    "resolve_intents": _sql(
        f"""SELECT u.request_id, CASE WHEN c.request_id IS NULL THEN u.intent ELSE c.intent END
            AS intent, CASE WHEN c.request_id IS NULL THEN u.confidence ELSE 0.8 END AS confidence,
            c.title, CASE WHEN c.request_id IS NOT NULL THEN 'cloud' END AS source
        FROM ruled u LEFT JOIN (SELECT request_id, {_INTENT} AS intent, {_key('title')} AS title
            FROM parsed) c ON c.request_id = u.request_id AND u.use_cloud AND u.confidence < 0.7""",
        "utterances",
        "ruled",
        "cloud_replies",
        parsed=_parsed("cloud_replies"),
    ),
    "transcript_gate": _sql(
        r"""SELECT event_id, nullif(t, '') AS text,
            CASE WHEN t = '' THEN 'Transcription failed' END AS error
        FROM (SELECT event_id, regexp_replace(transcript, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS t
            FROM transcripts)""",
        "transcripts",
    ),
    "call_turns": _CALL_TURNS,
    "stream_calls": _CALL_TURNS,
    "call_turns_landed": _CALL_TURNS,
    "model_infer_fallback": _sql(
        """SELECT request_id,
            CASE WHEN text LIKE 'Are you FREE%' THEN 'check_availability' ELSE 'unknown' END
                AS intent,
            CASE WHEN text LIKE 'Hello%' THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence,
            CASE WHEN text LIKE 'Are you FREE%' THEN 'Call' END AS title,
            CASE WHEN text LIKE 'Hello%' THEN 'rule' ELSE 'model' END AS origin
        FROM utterances""",
        "utterances",
    ),
    "process_text": _sql(
        """SELECT request_id, session_id, intent, confidence, source, response,
            CASE WHEN session_id IS NOT NULL THEN lag(record) OVER w END AS last_intent,
            CASE WHEN session_id IS NOT NULL THEN lag(response) OVER w END AS last_response
        FROM answered WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)""",
        "tasks",
        turns=f"""SELECT event_id AS request_id, user_id, ts, event_type,
            CASE WHEN event_id % 11 <> 0 THEN user_id::VARCHAR END AS session_id,
            event_type = 'signup' AND event_id % 2 = 0
                AND coalesce({_consent('event_id')}, false) AS escalated,
            CASE WHEN event_id % 11 <> 0 THEN user_id::VARCHAR ELSE '/' || event_id END AS k,
            row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS turn
            FROM events""",
        # turn by turn: the intent, and the title where it depends on the intent before
        meant="""SELECT request_id, k, turn,
                CASE event_type WHEN 'click' THEN 'check_availability' WHEN 'purchase'
                    THEN 'book_appointment' WHEN 'signup' THEN 'create_task' ELSE 'unknown' END AS intent,
                CASE WHEN escalated THEN 'Noted' END AS title
            FROM turns WHERE turn = 1
            UNION ALL
            SELECT t.request_id, t.k, t.turn,
                CASE event_type WHEN 'click' THEN 'check_availability' WHEN 'purchase'
                    THEN 'book_appointment' WHEN 'signup' THEN 'create_task'
                    WHEN 'error' THEN CASE m.intent WHEN 'create_task' THEN 'create_task' ELSE 'unknown' END
                    ELSE 'unknown' END,
                CASE WHEN escalated THEN CASE m.intent WHEN 'book_appointment' THEN 'Follow-up' ELSE 'Noted' END
                    WHEN event_type = 'error' AND m.intent = 'create_task' THEN 'More' END
            FROM meant m JOIN turns t ON t.k = m.k AND t.turn = m.turn + 1""",
        booked="""SELECT request_id FROM turns WHERE event_type = 'purchase'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) = 1""",
        noted="""SELECT request_id, (SELECT max(task_id) FROM tasks)
            + row_number() OVER (ORDER BY ts, request_id) AS task_id
            FROM turns JOIN meant USING (request_id) WHERE title IS NOT NULL""",
        answered="""SELECT t.request_id, session_id, ts, m.intent,
            CASE WHEN event_type = 'error' AND title IS NULL THEN 0.3
                WHEN event_type = 'signup' AND NOT escalated THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence,
            CASE WHEN escalated THEN 'cloud' END AS source,
            CASE m.intent WHEN 'check_availability' THEN 'I need a date and time to check availability.'
                WHEN 'book_appointment' THEN CASE WHEN b.request_id IS NULL THEN 'Slot not available'
                    ELSE 'Booked for February 15 at 10:00 AM' END
                WHEN 'create_task' THEN CASE WHEN title IS NOT NULL THEN 'Task created with ID ' || task_id || '.'
                    ELSE 'I didn''t get all the details. Please provide more information.' END
                ELSE 'I''m not sure how to help with that. Can you rephrase?' END AS response,
            CASE WHEN title IS NOT NULL THEN '{''intent'': ''create_task'', ''title'': ''' || title
                    || ''', ''confidence'': 0.8' || CASE WHEN escalated THEN ', ''source'': ''cloud''' ELSE '' END || '}'
                WHEN event_type = 'click'
                    THEN '{''intent'': ''check_availability'', ''title'': ''Call'', ''confidence'': 0.8}'
                WHEN event_type = 'purchase' THEN '{''intent'': ''book_appointment'', '
                    || '''datetime'': ''2024-02-15T10:00:00'', ''title'': ''Call'', ''confidence'': 0.8}'
                WHEN event_type = 'view'
                    THEN '{''intent'': ''unknown'', ''text'': ''Sorry, say again'', ''confidence'': 0.8}'
                WHEN event_type = 'error' THEN '{''intent'': ''unknown'', ''confidence'': 0.3}'
                ELSE '{''intent'': ''create_task'', ''confidence'': 0.5}' END AS record
            FROM turns t JOIN meant m USING (request_id) LEFT JOIN booked b USING (request_id)
            LEFT JOIN noted n USING (request_id)""",
    ),
    "validate_booking_requests": _sql(
        """SELECT form_id, payload->>'$.title' AS title,
            try_cast(payload->>'$.start_datetime' AS TIMESTAMP) AS "start",
            coalesce((payload->>'$.duration')::DOUBLE, 60)::DOUBLE AS duration_minutes,
            coalesce(array_to_string((payload->'$.attendees')::VARCHAR[], ','), '') AS attendees,
            CASE WHEN NOT list_contains(json_keys(payload), 'title')
                    OR NOT list_contains(json_keys(payload), 'start_datetime')
                    THEN 'Missing title or start_datetime'
                WHEN try_cast(payload->>'$.start_datetime' AS TIMESTAMP) IS NULL
                    THEN 'Invalid datetime' END AS reject_reason
        FROM booking_forms""",
        "booking_forms",
    ),
    "validate_availability_requests": _sql(
        """SELECT form_id, t AS "start", coalesce(duration, 60) AS duration_minutes,
            CASE WHEN t IS NULL THEN 'Invalid datetime format' END AS reject_reason
        FROM (SELECT *, try_cast(datetime_str AS TIMESTAMP) AS t FROM availability_forms)""",
        "availability_forms",
    ),
    "task_create": _sql(
        """SELECT request_id, task_id, title, description,
            'Task created with ID ' || task_id || '.' AS response
        FROM (SELECT event_id AS request_id, 'To do ' || event_id AS title,
            CASE WHEN event_id % 2 = 0 THEN 'from chat' END AS description,
            (SELECT max(task_id) FROM tasks) + row_number() OVER (ORDER BY ts, event_id) AS task_id
            FROM events WHERE event_id % 6 <> 0)""",
        "tasks",
    ),
    "image_task_link": _sql(
        """SELECT a.analysis_id, a.task_id, t.title, a.completion_status, a.error
        FROM analyses a LEFT JOIN tasks t ON t.task_id = a.task_id WHERE a.task_id <> 0""",
        "tasks",
        "analyses",
    ),
    "task_progress": _sql(
        """SELECT t.*, a.completion_status, a.error, a.ts AS updated_at
        FROM tasks t LEFT JOIN (SELECT * FROM analyses WHERE task_id <> 0
            QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, analysis_id DESC) = 1)
            a ON a.task_id = t.task_id""",
        "tasks",
        "analyses",
    ),
    "task_timeline": _sql(
        """SELECT user_id AS task_id, ts, event_id, event_type AS kind,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position
        FROM events WHERE user_id IN (SELECT task_id FROM tasks)""",
        "tasks",
    ),
}
