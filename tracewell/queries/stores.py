"""Queries of sources, stores, progress, rendering and recall, each beside its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import redact, text
from ..operators import confidence, events, nested, progress, recall, render, turns
from ..plans import pipelines
from ..providers import MANAGER_BODY, MANAGER_FACT, TfidfEmbedder
from ..runtime import materialise, scratch_path, table
from ..sources import logs, store
from . import core, core_sql
from .core import NOW, QUESTION

_NOW = dt.datetime(2031, 6, 1)
#: Fixed value: where the stream of calls is cut into batches.
CUTS = ("2031-03-20", "2031-04-25", "2031-05-10")


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Calls written as lines of JSON events and read back; a response that is a string is cut."""
    rows = table(spark, folder, "observations")
    line = F.to_json(F.struct("session_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "tool_name", F.col("tool_response_summary").alias("tool_response")))
    path = scratch_path(spark, "events")
    rows.select(line.alias("value")).write.text(path)
    return logs.events(spark, path).select("session_id", "ts", "tool_name", "tool_input_json", text.response_summary("tool_response", 100).alias("summary"))


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript lines written as one file for each session and read back; places are those in the file."""
    rows = table(spark, folder, "transcript").filter(F.col("line_no").isNotNull() & F.col("session_id").isNotNull())
    line = F.to_json(F.struct("type", "uuid", "timestamp"))
    path = scratch_path(spark, "sessions")
    ordered = rows.select(F.md5("session_id").alias("sid"), "line_no", line.alias("value")).repartition("sid").sortWithinPartitions("sid", "line_no", "value")
    ordered.select("sid", "value").write.partitionBy("sid").text(path)
    return logs.transcript(spark, path).select(F.regexp_extract("file", "sid=([0-9a-f]+)", 1).alias("session_hash"), "line_no", "type", "uuid", F.col("timestamp").alias("stamp"))


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories").withColumn("id", F.col("row_id").cast("string"))
    return logs.by_id(rows, "7").select("id", "batch_no", "description")


def live_dedup_state(spark: SparkSession, folder: str) -> DataFrame:
    """State entries (a session and when it was touched) that are not past their time."""
    rows = table(spark, folder, "session_progress").filter(F.col("updated_at").isNotNull())
    entries = rows.select(F.col("session_id").alias("key"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("value"))
    return store.live_state(entries, _NOW, ttl_s=30 * 86_400)


def appended_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The calls of May appended to a store of the older ones, without rows past retention."""
    rows = table(spark, folder, "observations")
    new = F.coalesce(F.col("ts") >= F.lit("2031-05-01").cast("timestamp"), F.lit(False))
    return events.appended(rows.filter(~new), rows.filter(new), _NOW, days=45).select("id", "session_id", "ts")


def upserted_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Memories of later batches put into those of batch 0 by id, whole rows, the last of equal ids."""
    rows = table(spark, folder, "memories").select("id", "row_id", "batch_no", "description")
    old = rows.filter((F.col("batch_no") == 0) & F.col("id").isNotNull())
    old = old.groupBy("id").agg(F.max(F.struct("row_id", "batch_no", "description")).alias("x")).select("id", "x.*")
    return store.upserted(old, rows.filter(F.col("batch_no") > 0), "id")


def _procedures(spark: SparkSession, folder: str) -> DataFrame:
    """Instincts in the form of procedures."""
    rows = table(spark, folder, "instincts")
    status = F.when(F.col("confidence") >= S.PROMOTE_AT, "promoted").otherwise("candidate")
    return rows.select(F.col("row_id").cast("string").alias("id"), F.col("trigger").alias("task_type"), "hit_count", "confidence", status.alias("status"), F.col("deprecated").alias("skill_asked"))


def pending_procedures(spark: SparkSession, folder: str) -> DataFrame:
    return render.pending_procedures(_procedures(spark, folder)).select("id", "task_type", "hit_count")


def pending_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of the most frequent pending procedures."""
    top = render.pending_procedures(_procedures(spark, folder)).orderBy(F.desc_nulls_last("hit_count"), "id").limit(20)
    return render.pending_prompts(top)


def asked_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Procedures after their pending ones were shown."""
    return pipelines.notify(_procedures(spark, folder))[1].select("id", "skill_asked")


def recalled_memories(spark: SparkSession, folder: str) -> DataFrame:
    """The whole rows of the memories nearest to the question, by a provider without a stable space."""
    rows = table(spark, folder, "memories").withColumn("id", F.col("row_id"))
    return recall.recall_top_k(rows, QUESTION, TfidfEmbedder(), k=10).select("id", "rank", "type", "description", "body")


def _counted(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


def synced_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector cache after the texts of all batches; vectors of unchanged texts of batch 0 are kept (marked -1 here)."""
    rows = table(spark, folder, "memories").select(F.col("row_id").cast("string").alias("memory_id"), "batch_no", text.cacheable_text("body", "keywords").alias("text"), F.col("description"))
    known = F.when(F.length("description") > 40, F.col("text")).otherwise(F.lit("outdated"))
    cache = rows.filter("batch_no = 0").select("memory_id", F.lit("m").alias("model"), text.content_hash(known).alias("content_hash"), F.array(F.lit(-1.0), F.lit(-1.0), F.lit(-1.0)).cast("array<float>").alias("embedding"))
    done = recall.sync_vectors(rows.select("memory_id", "text"), cache, _counted, "m")
    return done.select("memory_id", "content_hash", "stale", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)])


def nearest_cached(spark: SparkSession, folder: str) -> DataFrame:
    """The memories nearest to one vector among those of the cache."""
    vectors = synced_vectors(spark, folder).select(F.col("memory_id").cast("long").alias("id"), F.array("e0", "e1", "e2").alias("embedding"))
    return recall.nearest(vectors, [120.0, 10.0, 9.0], k=10, metric="l2").select("id", F.round("score", 6).alias("score"))


def claimed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Progress after every session of the transcript was claimed."""
    wanted = table(spark, folder, "transcript").filter(F.col("session_id").isNotNull()).select("session_id").distinct()
    return progress.claim(table(spark, folder, "session_progress"), wanted, _NOW)[0]


def claim_results(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "transcript").filter(F.col("session_id").isNotNull()).select("session_id").distinct()
    return progress.claim(table(spark, folder, "session_progress"), wanted, _NOW)[1]


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turns(core._first_lines(table(spark, folder, "transcript")))


def held_back_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """The last turn of each session that has a successor: the cursor after mining."""
    return turns.release_cursors(_turns(spark, folder))


def released_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Progress after the mined sessions were released at their new cursors."""
    cursors = materialise(turns.release_cursors(_turns(spark, folder)), "cursors")
    return progress.release(table(spark, folder, "session_progress"), cursors, _NOW)


def summary_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The new turns of each session as the text a summary is made of."""
    return turns.turns_text(_turns(spark, folder)).select("session_id", "turns", F.md5("text").alias("text_md5"), F.length("text").alias("characters"))


def summary_due_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions due at the operator's own threshold, or with any new turn where the session is being processed."""
    forced = table(spark, folder, "session_progress").filter(F.lower("status") == "processing").select("session_id")
    return progress.due_for_summary(_turns(spark, folder), forced)


def updated_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Recent sessions after the idle ones ended once more, a day later."""
    rows = table(spark, folder, "session_progress").filter(F.col("updated_at").isNotNull()).select("session_id", F.col("updated_at").alias("last_exit_ts"), F.coalesce("transcript_path", F.lit("")).alias("summary_excerpt"), "status")
    ended = rows.filter(F.lower("status") == "idle").select("session_id", (F.col("last_exit_ts") + F.expr("INTERVAL 1 DAY")).alias("last_exit_ts"), F.lit("ended again").alias("summary_excerpt"))
    return progress.recent_sessions(rows.drop("status"), ended)


def deduped_in_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The calls kept when they arrive in four batches: as many as when they arrive at once."""
    rows = table(spark, folder, "observations").withColumn("call_key", text.call_key("tool_name", "tool_input_json"))
    rows = materialise(rows.select("id", "ts", "call_key"), "keyed_calls")
    at = [F.lit(c).cast("timestamp") for c in CUTS]
    parts = [F.col("ts") < at[0], *[(F.col("ts") >= a) & (F.col("ts") < b) for a, b in zip(at, at[1:], strict=False)], F.col("ts").isNull() | (F.col("ts") >= at[-1])]
    state, out = None, None
    for part in parts:
        kept = materialise(events.dedup_windowed(rows.filter(part), ["call_key"], state=state), "kept")
        state = events.dedup_state(kept, ["call_key"], before=state)
        out = kept.select("id") if out is None else out.unionByName(kept.select("id"))
    return out


def redacted_strings(spark: SparkSession, folder: str) -> DataFrame:
    """All string values of each JSON input after redaction: their number and a hash of them, sorted."""
    rows = table(spark, folder, "observations").select("id", redact.redact_json("tool_input_json").alias("j"))
    strings = nested.shred(rows, "id", "j").filter("kind = 'string'")
    return strings.groupBy(F.col("row_key").alias("id")).agg(F.count("*").alias("strings"), F.md5(F.array_join(F.array_sort(F.collect_list("value")), "\n")).alias("values_md5"))


def masked_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with their summary redacted, or masked whole where the input or the summary names a sensitive file."""
    rows = table(spark, folder, "observations")
    masked = redact.mask_records(rows, redact.sensitive_path("tool_input_json", "tool_response_summary"), ["tool_input_json", "tool_response_summary"])
    return masked.select("id", "file", F.coalesce(F.col("tool_input_json") == redact.SENSITIVE_MASK, F.lit(False)).alias("input_masked"), "tool_response_summary")


def line_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "transcript")
    return rows.select("session_id", "line_no", "uuid", text.parse_time_us("timestamp").alias("us"))


def labelled_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories").withColumns({"rank": F.col("row_id")})
    return render.memory_lines(rows)


def habit_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "instincts").select("row_id", text.habit_line("domain", "trigger").alias("line"))


def package_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The facts the rule analyser finds in the sessions' digests."""
    _, facts = pipelines.analysed(core.session_digests(spark, folder))
    return facts.select("session_id", "name", "description", "body", "type", F.array_join("keywords", ",").alias("keywords"))


def context_document(spark: SparkSession, folder: str) -> DataFrame:
    """The context of a session start: a recap, the promoted habits, the memories nearest to the question."""
    rules = confidence.promoted(table(spark, folder, "instincts"), tie=["row_id"]).withColumn("id", F.col("row_id"))
    made = render.context_json("what was done", rules, recall.recall_top_k(table(spark, folder, "memories").withColumn("id", F.col("row_id")), QUESTION, TfidfEmbedder(), k=10))
    return made.select(F.from_json("context", "systemMessage string, additionalContext string").alias("c")).select("c.*")


def stored_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules document, written and read back."""
    path = scratch_path(spark, "rules")
    store.write_document(core.rules_document(spark, folder), path)
    return logs.document(spark, path).select(F.regexp_replace("text", r"\s+$", "").alias("text"))


def stored_rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The promoted instincts, written as one JSON array and read back."""
    rows = core.promoted_rules(spark, folder)
    path = scratch_path(spark, "rule-rows")
    rows.agg(F.to_json(F.collect_list(F.struct("row_id", "id", "confidence"))).alias("value")).coalesce(1).write.text(path)
    return logs.json_table(spark, path, "row_id long, id string, confidence double")


def stored_rule_map(spark: SparkSession, folder: str) -> DataFrame:
    """The promoted instincts, written as one JSON object of strings and read back."""
    rows = core.promoted_rules(spark, folder).filter(F.col("trigger").isNotNull())
    path = scratch_path(spark, "rule-map")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("row_id").cast("string"), "trigger")))).alias("value")).coalesce(1).write.text(path)
    return logs.json_map(spark, path)


def replaced_table(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table of sessions after two upserts; readers see the last version."""
    rows = table(spark, folder, "session_progress").select(*S.PROGRESS.fieldNames())
    kept = store.VersionedTable(spark, scratch_path(spark, "progress"), S.PROGRESS)
    kept.upsert(rows, "session_id")
    kept.upsert(rows.filter(F.lower("status") == "processing").withColumns({"status": F.lit("idle"), "updated_at": F.lit(_NOW)}), "session_id")
    return kept.read()


QUERIES = {
    f.__name__: f
    for f in (
        event_lines, session_files, point_lookup, live_dedup_state, appended_calls, upserted_memories, pending_procedures, pending_prompt, asked_flags, recalled_memories, synced_vectors, nearest_cached, claimed_sessions, claim_results,
        held_back_cursors, released_sessions, summary_texts, summary_due_forced, updated_sessions, deduped_in_batches, redacted_strings, masked_responses, line_times, labelled_facts, habit_lines, package_candidates, context_document,
        stored_rules, stored_rule_rows, stored_rule_map, replaced_table,
    )
}

_TS = f"TIMESTAMPTZ '{NOW}+00'"
_PROCEDURES = f"p AS (SELECT CAST(row_id AS VARCHAR) AS id, trigger AS task_type, hit_count, confidence >= {S.PROMOTE_AT} AND NOT coalesce(deprecated, false) AS pending, deprecated AS skill_asked FROM instincts)"
_PROMPT = "'" + render.PENDING_PROMPT.replace("%s", "' || {} || '").format("coalesce(task_type, '')", "coalesce(CAST(hit_count AS VARCHAR), '')", "id") + "'"
_TFIDF = core_sql.SQL["tfidf_recall"].strip()
_VECTORS = """
v AS (
  SELECT CAST(row_id AS VARCHAR) AS memory_id, sha256(t) AS content_hash, batch_no = 0 AND coalesce(length(description), 0) > 40 AS known,
    CAST(length(t) AS DOUBLE) AS a, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS b, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS c
  FROM (SELECT *, coalesce(body, '') || ' ' || coalesce(array_to_string(keywords, ' '), '') AS t FROM memories)
), w AS (SELECT memory_id, content_hash, false AS stale, CASE WHEN known THEN -1 ELSE a END AS e0, CASE WHEN known THEN -1 ELSE b END AS e1, CASE WHEN known THEN -1 ELSE c END AS e2 FROM v)
"""
_FACT_LINE = "CASE WHEN type IN ({}) THEN '[' || type || ']' ELSE '[user]' END || ' ' || trim(CASE WHEN description <> '' THEN description ELSE coalesce(body, '') END)".format(", ".join(f"'{t}'" for t in text.FACT_LABELS))
_HABIT = "'[habit][' || coalesce(domain, '') || '] ' || coalesce(trigger, '')"
_CLAIMED = f"""
d AS (
  SELECT coalesce(p.session_id, w.session_id) AS session_id, transcript_path, last_processed_uuid, status, updated_at, w.session_id IS NOT NULL AS wanted,
    p.session_id IS NULL OR lower(trim(coalesce(status, 'idle'))) <> 'processing' OR updated_at IS NULL OR floor(epoch({_TS})) - floor(epoch(updated_at)) >= 600 AS free
  FROM session_progress p FULL JOIN (SELECT DISTINCT session_id FROM transcript WHERE session_id IS NOT NULL) w ON w.session_id = p.session_id
)
"""
_CURSORS = f"{core_sql._FIRST_LINES}, cursors AS (SELECT session_id, arg_max(uuid, turn_no) AS cursor_ FROM (SELECT *, lead(turn_no) OVER (PARTITION BY session_id ORDER BY turn_no) AS n FROM turns) WHERE n IS NOT NULL GROUP BY session_id)"
_RELEASED = "SELECT p.session_id, transcript_path, coalesce(c.cursor_, last_processed_uuid) AS last_processed_uuid, CASE WHEN c.session_id IS NOT NULL THEN 'idle' ELSE status END AS status, CASE WHEN c.session_id IS NOT NULL THEN {} ELSE updated_at END AS updated_at FROM session_progress p LEFT JOIN cursors c ON c.session_id = p.session_id"

SQL = {
    "event_lines": "SELECT session_id, ts, tool_name, '{}' AS tool_input_json, left(tool_response_summary, 100) AS summary FROM observations",
    "session_files": """SELECT md5(session_id) AS session_hash, CAST(row_number() OVER (PARTITION BY session_id ORDER BY line_no, coalesce('{"type":' || to_json(type), '{') || coalesce(',"uuid":' || to_json(uuid), '') || coalesce(',"timestamp":' || to_json("timestamp"), '') || '}') - 1 AS INTEGER) AS line_no, type, uuid, "timestamp" AS stamp FROM transcript WHERE line_no IS NOT NULL AND session_id IS NOT NULL""",
    "point_lookup": "SELECT CAST(row_id AS VARCHAR) AS id, batch_no, description FROM memories WHERE row_id = 7",
    "live_dedup_state": f"SELECT session_id AS key, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS value FROM session_progress WHERE updated_at >= {_TS} - INTERVAL 30 DAY",
    "appended_calls": f"SELECT id, session_id, ts FROM observations WHERE ts >= {_TS} - INTERVAL 45 DAY",
    "upserted_memories": """
WITH n AS (SELECT * FROM memories WHERE batch_no > 0 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1 UNION ALL SELECT * FROM memories WHERE batch_no > 0 AND id IS NULL),
o AS (SELECT * FROM memories WHERE batch_no = 0 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)
SELECT id, row_id, batch_no, description FROM n UNION ALL SELECT id, row_id, batch_no, description FROM o WHERE id NOT IN (SELECT id FROM n WHERE id IS NOT NULL)
""",
    "pending_procedures": f"WITH {_PROCEDURES} SELECT id, task_type, hit_count FROM p WHERE pending",
    "pending_prompt": f"WITH {_PROCEDURES}, t AS (SELECT * FROM p WHERE pending ORDER BY hit_count DESC NULLS LAST, id LIMIT 20) SELECT string_agg({_PROMPT}, chr(10) || chr(10) ORDER BY id || '.md') AS text FROM t HAVING count(*) > 0".replace("\n", "' || chr(10) || '"),
    "asked_flags": f"WITH {_PROCEDURES} SELECT id, CASE WHEN pending THEN true ELSE skill_asked END AS skill_asked FROM p",
    "recalled_memories": f"SELECT r.id, r.rank, m.type, m.description, m.body FROM ({_TFIDF}) r JOIN memories m ON m.row_id = r.id",
    "synced_vectors": f"WITH {_VECTORS} SELECT * FROM w",
    "nearest_cached": f"WITH {_VECTORS} SELECT CAST(memory_id AS BIGINT) AS id, round(sqrt((e0 - 120) ** 2 + (e1 - 10) ** 2 + (e2 - 9) ** 2), 6) AS score FROM w ORDER BY sqrt((e0 - 120) ** 2 + (e1 - 10) ** 2 + (e2 - 9) ** 2), id LIMIT 10",
    "claimed_sessions": f"WITH {_CLAIMED} SELECT session_id, transcript_path, last_processed_uuid, CASE WHEN wanted AND free THEN 'processing' ELSE status END AS status, CASE WHEN wanted AND free THEN {_TS} ELSE updated_at END AS updated_at FROM d",
    "claim_results": f"WITH {_CLAIMED} SELECT session_id, free AS claimed, CASE WHEN free THEN last_processed_uuid END AS cursor FROM d WHERE wanted",
    "held_back_cursors": f"WITH {_CURSORS} SELECT session_id, cursor_ AS last_processed_uuid FROM cursors",
    "released_sessions": f"WITH {_CURSORS} {_RELEASED.format(_TS)}",
    "summary_texts": f"""
WITH {core_sql._FIRST_LINES}, b AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_no) AS n, coalesce(uuid, '') AS uuid, coalesce({core_sql._cut("user_", 4000, "...(截断)")}, '') AS u, coalesce({core_sql._cut("assistant_", 4000, "...(截断)")}, '') AS a FROM turns
), t AS (
  SELECT session_id, count(*) AS turns, string_agg('### Turn ' || n || ' (uuid: ' || uuid || ')' || chr(10) || '[user]' || chr(10) || u || chr(10) || '[assistant]' || chr(10) || a, chr(10) || chr(10) ORDER BY n) AS text FROM b GROUP BY session_id
)
SELECT session_id, turns, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS characters FROM t
""",
    "summary_due_forced": f"WITH {core_sql._FIRST_LINES} SELECT session_id, count(*) AS new_turns FROM turns GROUP BY session_id HAVING count(*) >= {S.SUMMARIZE_AT_TURNS} OR session_id IN (SELECT session_id FROM session_progress WHERE lower(status) = 'processing')",
    "updated_sessions": """
WITH s AS (
  SELECT session_id, updated_at AS last_exit_ts, left(coalesce(transcript_path, ''), 200) AS summary_excerpt FROM session_progress WHERE updated_at IS NOT NULL AND session_id <> ''
  UNION ALL SELECT session_id, updated_at + INTERVAL 1 DAY, 'ended again' FROM session_progress WHERE updated_at IS NOT NULL AND session_id <> '' AND lower(status) = 'idle'
)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY last_exit_ts DESC) = 1 ORDER BY last_exit_ts DESC, session_id LIMIT 10
""",
    "deduped_in_batches": core_sql.SQL["dedup_calls"],
    "redacted_strings": f"""
WITH docs AS MATERIALIZED (SELECT id, tool_input_json AS js FROM observations WHERE tool_input_json <> '' AND json_valid(tool_input_json)),
s AS (SELECT docs.id, j.value ->> '$' AS v FROM docs, json_tree(docs.js) j WHERE j.type = 'VARCHAR')
SELECT id, count(*) AS strings, md5(string_agg({core_sql._redacted("v")}, chr(10) ORDER BY {core_sql._redacted("v")})) AS values_md5 FROM s GROUP BY id
""",
    "masked_responses": f"""
WITH {core_sql._FIRST_PATH}, named AS (SELECT id, path FROM paths WHERE {core_sql._SENSITIVE}),
seen AS ({{summary}})
SELECT o.id, coalesce(n.path, s.path) AS file, coalesce(n.path, s.path) IS NOT NULL AS input_masked,
  CASE WHEN coalesce(n.path, s.path) IS NOT NULL THEN '{redact.SENSITIVE_MASK}' ELSE {core_sql._redacted("tool_response_summary")} END AS tool_response_summary
FROM observations o LEFT JOIN named n ON n.id = o.id LEFT JOIN seen s ON s.id = o.id
""".replace("{summary}", f"WITH {core_sql._FIRST_PATH.replace('tool_input_json', 'tool_response_summary')} SELECT id, path FROM paths WHERE {core_sql._SENSITIVE}"),
    "line_times": f"SELECT session_id, line_no, uuid, {core_sql._LINE_US} AS us FROM transcript",
    "labelled_facts": f"SELECT row_id AS rank, {_FACT_LINE} AS line FROM memories",
    "habit_lines": f"SELECT row_id, {_HABIT} AS line FROM instincts",
    "context_document": f"""
WITH h AS (SELECT string_agg({_HABIT}, chr(10) ORDER BY -confidence, row_id) AS t, count(*) AS n FROM (SELECT * FROM instincts WHERE NOT coalesce(deprecated, false) AND confidence >= 0.7 ORDER BY confidence DESC, row_id LIMIT 30)),
f AS (SELECT string_agg({_FACT_LINE}, chr(10) ORDER BY rank) AS t, count(*) AS n FROM ({_TFIDF}) r JOIN memories m ON m.row_id = r.id)
SELECT '[project-recap]' || chr(10) || '[habit] ' || h.n || chr(10) || '[memory] ' || f.n AS "systemMessage", '[project-recap]' || chr(10) || 'what was done' || chr(10) || h.t || chr(10) || f.t AS "additionalContext" FROM h, f
""",
    "stored_rules": f"SELECT rtrim(text, ' ' || chr(10)) AS text FROM ({core_sql.SQL['rules_document'].strip()})",
    "stored_rule_rows": f"SELECT row_id, id, confidence FROM ({core_sql.SQL['promoted_rules']})",
    "stored_rule_map": f"SELECT CAST(row_id AS VARCHAR) AS key, trigger AS value FROM ({core_sql.SQL['promoted_rules']}) WHERE trigger IS NOT NULL",
    "replaced_table": f"SELECT session_id, transcript_path, last_processed_uuid, CASE WHEN lower(status) = 'processing' THEN 'idle' ELSE status END AS status, CASE WHEN lower(status) = 'processing' THEN {_TS} ELSE updated_at END AS updated_at FROM session_progress",
    "package_candidates": "WITH d AS ({digests}) ".replace("{digests}", core_sql.DIGESTS) + " UNION ALL ".join(rf"SELECT session_id, 'uses-{m}' AS name, '{MANAGER_FACT % m}' AS description, '{MANAGER_BODY % m}' AS body, 'project' AS type, '{m}' AS keywords FROM d WHERE regexp_matches(digest, '\b{m}\b')" for m in text.PACKAGE_MANAGERS),
}
