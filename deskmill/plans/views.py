"""Assistant tables derived from the given ones, by projection of whole tables.

Every event plays each role once: as an appointment, as a request, as an
utterance. ``oracle.py`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskmill.schemas import EVENTS

HOUR = "date_trunc('hour', ts)"

TEXT = """CASE event_type WHEN 'click' THEN 'Are you FREE then?'
    WHEN 'view' THEN 'Please book a room' WHEN 'signup' THEN 'Add a todo item'
    WHEN 'purchase' THEN 'Schedule it if available' ELSE 'Hello there' END"""

CONSENT = "CASE {id} % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with zoned time, as interval work and watermarks need it."""
    return zoned(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return zoned(reader.parquet(sf_dir))


def zoned(raw: DataFrame) -> DataFrame:
    return raw.selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "event_type")


def appointments(ev: DataFrame) -> DataFrame:
    """Lengths of 0 to 480 minutes on the hour grid, so that many touch."""
    return ev.selectExpr(
        "event_id AS id",
        "user_id AS calendar_id",
        "concat(event_type, ' #', event_id) AS title",
        f"{HOUR} AS start",
        f"{HOUR} + make_dt_interval(0, 0, cast(30 * (event_id % 17) AS int)) AS end",
        "CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'view' THEN NULL"
        " ELSE 'confirmed' END AS status",
    )


def requests(ev: DataFrame) -> DataFrame:
    """Wishes for the next day, of -30 to 510 minutes."""
    return ev.selectExpr(
        "event_id AS request_id",
        "user_id AS calendar_id",
        "ts AS arrival",
        "concat('Visit ', event_id) AS title",
        f"{HOUR} + INTERVAL 26 HOURS AS start",
        "cast(30 * (event_id % 19) - 30 AS int) AS duration_minutes",
        "CASE WHEN event_id % 4 != 0 THEN array(concat('user', user_id, '@example.com')) END"
        " AS attendees",
    )


def utterances(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS request_id",
        "event_id",
        "CASE WHEN event_id % 11 != 0 THEN cast(user_id AS string) END AS session_id",
        "ts",
        f"{TEXT} AS text",
        "event_id % 2 = 0 AS use_cloud",
        f"{CONSENT.format(id='event_id')} AS user_consent",
    )


def turns(ev: DataFrame) -> DataFrame:
    """Utterances with the calendar they speak of."""
    return ev.selectExpr(
        "event_id AS request_id",
        "event_id",
        "user_id AS calendar_id",
        "CASE WHEN event_id % 11 != 0 THEN cast(user_id AS string) END AS session_id",
        "ts",
        f"{TEXT} AS text",
        "event_id % 2 = 0 AS use_cloud",
        f"{CONSENT.format(id='event_id')} AS user_consent",
    )


def call_turns(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "concat('CA', user_id) AS call_sid",
        "ts",
        "event_id",
        "concat('+1555', lpad(cast(user_id AS string), 7, '0')) AS from_number",
        f"CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' ELSE {TEXT} END"
        " AS speech_result",
    )


def transcripts(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id",
        "concat(chr(160), chr(9), CASE WHEN event_id % 10 = 0 THEN '' ELSE "
        f"{TEXT} END, ' ', chr(10)) AS transcript",
    )


DAY_TEXT = "date_format(ts, 'yyyy-MM-dd')"
TIME_TEXT = f"concat({DAY_TEXT}, 'T', date_format(ts, 'HH:mm:ss'))"


def booking_forms(ev: DataFrame) -> DataFrame:
    """Good and bad booking forms, by ``event_id % 8``."""
    when = f"""CASE event_id % 8 WHEN 2 THEN '2024-13-01T10:00:00' WHEN 4 THEN {DAY_TEXT}
        WHEN 7 THEN replace({TIME_TEXT}, 'T', ' ') ELSE {TIME_TEXT} END"""
    title = "CASE event_id % 8 WHEN 3 THEN '' ELSE concat('Visit ', event_id) END"
    return ev.selectExpr(
        "event_id AS form_id",
        f"""concat('{{"note": 1',
            CASE WHEN event_id % 8 = 0 THEN '' ELSE concat(', "title": "', {title}, '"') END,
            CASE WHEN event_id % 8 = 1 THEN ''
                 ELSE concat(', "start_datetime": "', {when}, '"') END,
            CASE WHEN event_id % 8 = 5 THEN ''
                 ELSE concat(', "duration": ', CASE WHEN event_id % 7 = 3 THEN '45.5'
                     ELSE cast(15 * (event_id % 7) AS string) END) END,
            CASE WHEN event_id % 8 = 6
                 THEN concat(', "attendees": ["a', user_id, '@example.com", "b@example.com"]')
                 ELSE '' END, '}}') AS payload""",
    )


def availability_forms(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS form_id",
        f"""CASE event_id % 8 WHEN 2 THEN '2024-13-01T10:00:00' WHEN 3 THEN 'next week'
            WHEN 4 THEN {DAY_TEXT} WHEN 5 THEN concat({TIME_TEXT}, 'Z')
            WHEN 7 THEN replace({TIME_TEXT}, 'T', ' ') ELSE {TIME_TEXT} END AS datetime_str""",
        "CASE WHEN event_id % 5 != 0 THEN cast(15 * (event_id % 7) AS int) END AS duration",
    )


def _reply(variant: str) -> str:
    """A model reply of one of nine kinds."""
    moment = (
        "CASE WHEN event_id % 11 = 0 THEN 'next Tuesday' ELSE "
        f"date_format({HOUR} + INTERVAL 26 HOURS, \"yyyy-MM-dd'T'HH:mm:ss\") END"
    )
    return f"""CASE {variant}
        WHEN 0 THEN 'I could not find anything.'
        WHEN 1 THEN concat('{{"intent": "check_availability", "datetime": "', {moment}, '"}}')
        WHEN 2 THEN concat('Sure: {{"intent": "book_appointment", "datetime": "', {moment},
            '", "title": "Visit ', event_id, '"}} as you wished')
        WHEN 3 THEN '{{"intent": "create_task", "title": "A"}} {{"b": 2}}'
        WHEN 4 THEN concat('{{', chr(39), 'intent', chr(39), ': ', chr(39), 'unknown', chr(39), '}}')
        WHEN 5 THEN concat('{{', chr(10), '  "intent": "create_task",', chr(10),
            '  "title": "Task ', event_id, '"', chr(10), '}}')
        WHEN 6 THEN '{{"intent": "cancel_appointment", "confidence": 0.99}}'
        WHEN 7 THEN concat('{{"intent": "check_availability", "datetime": "', {moment},
            '", "duration": ', CASE event_id % 5 WHEN 0 THEN '999999999999' WHEN 1 THEN '-30'
                WHEN 2 THEN '22.5' ELSE '90' END, ', "duration_minutes": 30}}')
        ELSE '{{"intent": "book_appointment"' END"""


def model_replies(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS request_id",
        "user_id AS calendar_id",
        "ts AS arrival",
        f"{_reply('event_id % 9')} AS reply",
    )


def cloud_replies(ev: DataFrame) -> DataFrame:
    """Cloud answers, which came for three of the five kinds of events."""
    return ev.filter("event_type IN ('click', 'error', 'view')").selectExpr(
        "event_id AS request_id", f"{_reply('(event_id + 1) % 9')} AS reply"
    )


def outbound_input(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id",
        "text",
        "doc_id % 2 = 0 AS use_cloud",
        f"{CONSENT.format(id='doc_id')} AS user_consent",
        "CASE doc_id % 3 WHEN 1 THEN 0.5D WHEN 2 THEN 0.8D END AS confidence",
    )


def calendars(ev: DataFrame) -> DataFrame:
    return ev.selectExpr("user_id AS calendar_id").distinct()


def windows(ev: DataFrame) -> DataFrame:
    """Working hours on the weekdays on which a calendar's owner signed up."""
    return (
        ev.filter("event_type = 'signup'")
        .selectExpr("user_id AS calendar_id", "weekday(ts) AS day_of_week")
        .distinct()
        .selectExpr(
            "*", "'08:00' AS start_time", "'16:00' AS end_time", "10 AS buffer_minutes"
        )
    )


def tasks(ev: DataFrame) -> DataFrame:
    """One task per user who signed up."""
    return (
        ev.filter("event_type = 'signup'")
        .groupBy("user_id")
        .agg({"ts": "min"})
        .selectExpr(
            "user_id AS task_id",
            "concat('Task ', user_id) AS title",
            "`min(ts)` + INTERVAL 7 DAYS AS due_date",
        )
    )


def task_requests(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS request_id",
        "ts",
        "CASE WHEN event_id % 6 != 0 THEN concat('To do ', event_id) END AS title",
        "CASE WHEN event_id % 2 = 0 THEN 'from chat' END AS description",
    )


def task_events(ev: DataFrame) -> DataFrame:
    return ev.selectExpr("user_id AS task_id", "ts", "event_id", "event_type AS kind")


def analyses(ev: DataFrame) -> DataFrame:
    failed = "event_type = 'error'"
    return ev.selectExpr(
        "event_id AS analysis_id",
        "ts",
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 10 = 3 THEN 0L ELSE user_id END"
        " AS task_id",
        f"CASE WHEN NOT {failed} THEN concat('Image ', event_id) END AS image",
        f"""CASE WHEN {failed} THEN NULL WHEN event_id % 2 = 0 THEN 'completed'
            ELSE 'in progress' END AS completion_status""",
        f"CASE WHEN {failed} THEN 'model not loaded' END AS error",
    )
