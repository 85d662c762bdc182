"""Row types of the relations the engine reads and writes."""

from pyspark.sql import types as T


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "ARRAY<STRING>": T.ArrayType(T.StringType()), "ARRAY<FLOAT>": T.ArrayType(T.FloatType())}


def _of(ddl: str) -> T.StructType:
    """A flat schema from ``name TYPE, ..``, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (column.split(" ") for column in ddl.split(", "))])


OBSERVATION = _of("id BIGINT, session_id STRING, ts TIMESTAMP, tool_name STRING, tool_input_json STRING, tool_response_summary STRING")
TRANSCRIPT_LINE = _of("session_id STRING, line_no INT, type STRING, uuid STRING, timestamp STRING, message STRING")
TURN = _of("session_id STRING, turn_no INT, uuid STRING, user STRING, assistant STRING, ts TIMESTAMP")
INSTINCT = _of("id STRING, domain STRING, trigger STRING, confidence DOUBLE, hit_count INT, deprecated BOOLEAN, last_seen DATE, scope STRING, body STRING")
INSTINCT_CANDIDATE = _of("seq BIGINT, id STRING, trigger STRING, action STRING, domain STRING, evidence STRING")
MEMORY = _of("id STRING, type STRING, keywords ARRAY<STRING>, description STRING, created DATE, body STRING")
FACT_CANDIDATE = _of("seq BIGINT, name STRING, description STRING, body STRING, type STRING, keywords ARRAY<STRING>")
PROCEDURE = _of("id STRING, task_type STRING, hit_count INT, confidence DOUBLE, status STRING, skill_asked BOOLEAN, first_seen DATE, last_seen DATE, evidence_sessions ARRAY<STRING>, body STRING")
PROCEDURE_CANDIDATE = _of("seq BIGINT, session_id STRING, id STRING, task_type STRING, steps ARRAY<STRING>, note STRING, is_successful BOOLEAN")
PROGRESS = _of("session_id STRING, transcript_path STRING, last_processed_uuid STRING, status STRING, updated_at TIMESTAMP")
RECENT_SESSION = _of("session_id STRING, last_exit_ts TIMESTAMP, summary_excerpt STRING")
VECTOR = _of("memory_id STRING, model STRING, content_hash STRING, embedding ARRAY<FLOAT>")

#: Thresholds and sizes of the pipelines.
INITIAL_CONFIDENCE, HIT_STEP, MISS_STEP, CONFIDENCE_CAP = 0.5, 0.05, 0.05, 0.9
PROMOTE_AT, DEPRECATE_AT, RULES_LIMIT = 0.7, 0.55, 30
SIMILAR_FROM = 0.45
DEDUP_WINDOW_S, DEDUP_STATE_TTL_S, RETENTION_DAYS, LEASE_STALE_S = 300, 3600, 30, 600
RESPONSE_CUT, TURN_CUT, DIGEST_CUT, EXAMPLE_CUT, STEP_CUT, EXAMPLES_PER_TOOL = 500, 4000, 4000, 200, 150, 3
LOOKBACK, MIN_EDITS, MIN_READ_RATIO, MIN_SHELL_CALLS, MIN_EPISODE_CALLS = 3, 2, 0.7, 3, 3
SUMMARIZE_AT_TURNS, RECALL_K, RECENT_SESSIONS, EXCERPT_CUT, ID_CUT = 100, 5, 10, 200, 80
FORCE_EVENTS = ("PreCompact", "SessionEnd")
