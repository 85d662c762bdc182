"""DuckDB SQL that must give the rows of the core queries."""

from __future__ import annotations

from ..functions.redact import MASK, PATTERNS, SENSITIVE_PARTS
from ..functions.text import PACKAGE_MANAGERS, SLUG_CHARACTERS
from ..operators.detect import NO_COMMIT, READ_FIRST
from ..operators.render import RULES_HEAD
from .core import NOW, QUESTION


def _redacted(c: str) -> str:
    for p in PATTERNS:
        c = f"regexp_replace({c}, '{p}', '{MASK}', 'g')"
    return c


def _slug(c: str) -> str:
    return f"(CASE WHEN regexp_replace(regexp_replace(trim({c}), '[^{SLUG_CHARACTERS}]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN left(md5({c}), 8) ELSE left(lower(regexp_replace(regexp_replace(trim({c}), '[^{SLUG_CHARACTERS}]+', '-', 'g'), '^-+|-+$', '', 'g')), 80) END)"


def _field(c: str, name: str) -> str:
    return f"(CASE WHEN json_valid({c}) AND json_type(TRY_CAST({c} AS JSON)) = 'OBJECT' THEN TRY_CAST({c} AS JSON) ->> '$.{name}' END)"


#: Microseconds of a time stamp in ISO notation or of epoch milliseconds.
_LINE_US = """CASE WHEN regexp_full_match(trim("timestamp"), '[0-9]{12,14}') THEN CAST(trim("timestamp") AS BIGINT) * 1000 ELSE epoch_us(TRY_CAST(trim("timestamp") AS TIMESTAMPTZ)) END"""
_FIRST_LINES = f"""
timed AS (SELECT *, {_LINE_US} AS us FROM transcript WHERE session_id IS NOT NULL),
first_lines AS (
  SELECT * FROM timed WHERE uuid <> '' QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY line_no NULLS LAST, us NULLS LAST, "timestamp" NULLS FIRST, type NULLS FIRST, message NULLS FIRST) = 1
  UNION ALL SELECT * FROM timed WHERE coalesce(uuid, '') = ''
), parsed AS (
  SELECT session_id, line_no, uuid, type, us, make_timestamptz(us) AS ts,
    CASE WHEN json_valid(message) AND json_type(TRY_CAST(message AS JSON)) = 'OBJECT' THEN json_extract(TRY_CAST(message AS JSON), '$.content') END AS content
  FROM first_lines
), rows_ AS (
  SELECT *, type = 'user' AND coalesce(uuid, '') <> '' AND coalesce(json_type(content) = 'VARCHAR', false) AS is_prompt FROM parsed
), said AS (
  SELECT session_id, line_no, uuid, us, ts, is_prompt,
    CASE WHEN json_type(content) = 'VARCHAR' THEN content ->> '$'
         WHEN json_type(content) = 'ARRAY' THEN list_aggregate([coalesce(b ->> '$.text', '') FOR b IN CAST(content AS JSON[]) IF b ->> '$.type' = 'text'], 'string_agg', chr(10)) END AS text
  FROM rows_ WHERE is_prompt OR type = 'assistant'
), numbered AS (
  SELECT *, CAST(count_if(is_prompt) OVER (PARTITION BY session_id ORDER BY line_no NULLS LAST, us NULLS LAST, uuid NULLS FIRST ROWS UNBOUNDED PRECEDING) AS INTEGER) AS turn_no FROM said
), turns AS (
  SELECT session_id, turn_no, max(uuid) FILTER (is_prompt) AS uuid, max(text) FILTER (is_prompt) AS user_, max(ts) FILTER (is_prompt) AS ts,
    coalesce(string_agg(text, chr(10) ORDER BY line_no NULLS LAST, us NULLS LAST, uuid NULLS FIRST, text) FILTER (NOT is_prompt AND text <> ''), '') AS assistant_
  FROM numbered WHERE turn_no > 0 GROUP BY session_id, turn_no
)
"""


def _cut(c: str, n: int, suffix: str) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '{suffix}' ELSE {c} END"


def _knn(score: str, order: str, source: str = "embeddings") -> str:
    return f"""
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 6) AS score
  FROM embeddings q JOIN {source} c ON q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 5
"""


def _characters(c: str) -> str:
    return f"list_distinct(list_filter(string_split(replace(coalesce({c}, ''), ' ', ''), ''), lambda x: x <> ''))"


def _best(condition: str, text: str, source: str) -> str:
    return f"""
WITH r AS (SELECT *, {_characters(text)} AS ch FROM {source}), p AS (
  SELECT a.row_id AS query_id, b.row_id AS match_id, len(list_intersect(a.ch, b.ch)) AS shared, len(a.ch) AS na, len(b.ch) AS nb
  FROM r a JOIN r b ON a.row_id % 100 = 0 AND b.row_id <> a.row_id AND {condition}
), s AS (SELECT query_id, match_id, shared / (na + nb - shared) AS score FROM p WHERE na > 0 AND nb > 0)
SELECT query_id, match_id, round(score, 9) AS score FROM s WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) = 1
"""


_SENSITIVE = " OR ".join(f"contains(lower(path), '{p}')" for p in SENSITIVE_PARTS)
_PATH, _COMMAND = _field("tool_input_json", "file_path"), _field("tool_input_json", "command")
#: The first object in reading order, lists not entered, that has a path field; an empty path below the root does not count.
_FIRST_PATH = f"""
docs AS MATERIALIZED (SELECT id, tool_input_json AS js FROM observations WHERE tool_input_json <> '' AND json_valid(tool_input_json)),
nodes AS (
  SELECT o.id AS call, j.id AS n, j.parent, j.key, j.type, j.fullkey, CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$' END AS text
  FROM docs o, json_tree(o.js) j
), held AS (
  SELECT call, parent AS n, arg_min(text, list_position(['file_path', 'path', 'notebook_path', 'filename'], key)) AS path, min(parent) AS at_ FROM nodes
  WHERE key IN ('file_path', 'path', 'notebook_path', 'filename') AND type = 'VARCHAR' GROUP BY call, parent
), paths AS (
  SELECT h.call AS id, arg_min(h.path, h.n) AS path FROM held h JOIN nodes p ON p.call = h.call AND p.n = h.n
  WHERE p.type = 'OBJECT' AND NOT contains(p.fullkey, '[') AND (h.path <> '' OR h.n = 0) GROUP BY h.call
)
"""
#: The tool and its input, as a sorted list of paths and values where it is JSON.
_CALL_KEYS = """
docs AS MATERIALIZED (SELECT id, tool_input_json AS js FROM observations WHERE tool_input_json <> '' AND json_valid(tool_input_json)),
leaves AS (
  SELECT o.id, list(j.fullkey || chr(1) || j.type || chr(1) || CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN '' ELSE coalesce(CAST(j.atom AS VARCHAR), 'null') END ORDER BY j.fullkey, j.type, j.atom) AS x
  FROM docs o, json_tree(o.js) j GROUP BY o.id
), call_keys AS (
  SELECT o.id, o.ts, md5(coalesce(tool_name, '') || ':' || CASE WHEN tool_input_json IS NULL THEN '["$' || chr(1) || 'OBJECT' || chr(1) || '"]' WHEN l.id IS NOT NULL THEN CAST(to_json(x) AS VARCHAR) ELSE 'raw' || tool_input_json END) AS call_key
  FROM observations o LEFT JOIN leaves l ON l.id = o.id
)
"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

_FIRST_CALLS = """
c AS (SELECT session_id, id, coalesce(tool_name, 'unknown') AS tool_name, coalesce(tool_input_json, '{}') AS j FROM observations),
e AS (SELECT *, CASE WHEN length(j) > 200 THEN left(j, 200) || '...' ELSE j END AS example, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY id) AS n FROM c),
g AS (SELECT session_id, tool_name, count(*) AS calls, min(id) AS first_id, list(example ORDER BY n) FILTER (n <= 3) AS examples FROM e GROUP BY session_id, tool_name)
"""
#: (session_id, calls, digest)
DIGESTS = f"""
WITH {_FIRST_CALLS}, t AS (
  SELECT session_id, calls, first_id, '- ' || tool_name || ': 共 ' || calls || ' 次' || chr(10) || array_to_string(list_transform(examples, lambda x: '  例: ' || x), chr(10)) AS text FROM g WHERE session_id IS NOT NULL
), w AS (
  SELECT session_id, CAST(sum(calls) AS BIGINT) AS calls, '本次会话共 ' || CAST(sum(calls) AS BIGINT) || ' 条观测记录，按工具类型汇总：' || chr(10) || string_agg(text, chr(10) ORDER BY first_id, text) AS whole FROM t GROUP BY session_id
)
SELECT session_id, calls, {_cut("whole", 4000, "...(截断)")} AS digest FROM w
"""

SQL = {
    "session_digests": DIGESTS,
    "detected_patterns": f"""
WITH r AS ({{reads}}), k AS ({{commits}})
SELECT session_id, '{READ_FIRST["id"]}' AS id, '{READ_FIRST["trigger"]}' AS trigger, '{READ_FIRST["action"]}' AS action, '{READ_FIRST["domain"]}' AS domain, read_first || '/' || edits || ' 次编辑前有先 Read' AS evidence, 0 AS detector FROM r WHERE edits >= 2 AND read_first / edits >= 0.7
UNION ALL SELECT session_id, '{NO_COMMIT["id"]}', '{NO_COMMIT["trigger"]}', '{NO_COMMIT["action"]}', '{NO_COMMIT["domain"]}', '本次会话 ' || shell_calls || ' 次 Bash 调用中无 commit/push', 1 FROM k
""",
    "redact_calls": f"SELECT id, {_redacted('tool_input_json')} AS tool_input, {_redacted('tool_response_summary')} AS response FROM observations",
    "redaction_stats": f"SELECT tool_name, count(*) AS calls, count_if(coalesce(tool_input_json <> {_redacted('tool_input_json')}, false)) AS inputs, count_if(coalesce(tool_response_summary <> {_redacted('tool_response_summary')}, false)) AS responses FROM observations GROUP BY tool_name",
    "sensitive_calls": f"WITH {_FIRST_PATH} SELECT id, path FROM paths WHERE {_SENSITIVE}",
    "response_cuts": f"SELECT id, {_cut('tool_response_summary', 200, '...')} AS brief FROM observations",
    "dedup_calls": f"""
WITH RECURSIVE {_CALL_KEYS}, k AS (
  SELECT id, ts, call_key, row_number() OVER (PARTITION BY call_key ORDER BY ts, id) AS n FROM call_keys WHERE ts IS NOT NULL
), fold(call_key, n, id, last, kept) AS (
  SELECT call_key, n, id, ts, true FROM k WHERE n = 1
  UNION ALL
  SELECT k.call_key, k.n, k.id, CASE WHEN k.ts >= f.last + INTERVAL 300 SECOND THEN k.ts ELSE f.last END, k.ts >= f.last + INTERVAL 300 SECOND
  FROM fold f JOIN k ON k.n = f.n + 1 AND k.call_key = f.call_key
)
SELECT id FROM fold WHERE kept UNION ALL SELECT id FROM observations WHERE ts IS NULL
""",
    "call_keys": f"WITH {_CALL_KEYS} SELECT id, min(id) OVER (PARTITION BY call_key) AS first_id FROM call_keys",
    "retained_calls": f"SELECT id, session_id FROM observations WHERE ts >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 30 DAY",
    "incremental_scan": "SELECT id, session_id, tool_name FROM observations WHERE id > 100",
    "range_scan": "SELECT id, session_id, tool_name FROM observations WHERE ts >= TIMESTAMPTZ '2031-03-12 00:00:00+00' AND ts < TIMESTAMPTZ '2031-04-01 00:00:00+00'",
    "transcript_turns": f"WITH {_FIRST_LINES} SELECT session_id, turn_no, uuid, {_cut('user_', 4000, '...(截断)')} AS user, {_cut('assistant_', 4000, '...(截断)')} AS assistant FROM turns",
    "turns_after_cursor": f"WITH {_FIRST_LINES} SELECT t.session_id, t.turn_no, t.uuid FROM turns t LEFT JOIN (SELECT t.session_id, min(turn_no) AS seen FROM turns t JOIN session_progress p ON p.session_id = t.session_id AND p.last_processed_uuid = t.uuid GROUP BY 1) c ON c.session_id = t.session_id WHERE t.turn_no > coalesce(c.seen, 0)",
    "turn_feedback": f"WITH {_FIRST_LINES}, f AS (SELECT session_id, turn_no, uuid, lead({_cut('user_', 4000, '...(截断)')}) OVER w AS next_user, lead(turn_no) OVER w AS n FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)) SELECT session_id, turn_no, uuid, next_user FROM f WHERE n IS NOT NULL",
    "episode_steps": f"""
WITH {_FIRST_LINES}, f AS (SELECT *, lead(ts) OVER w AS next_ts FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)),
open_ AS (SELECT session_id, turn_no, uuid, coalesce(ts, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS ts, next_ts FROM f WHERE next_ts IS NOT NULL),
owned AS (
  SELECT o.id, t.session_id, t.turn_no, t.uuid, t.next_ts, o.ts AS called FROM observations o JOIN open_ t ON o.session_id = t.session_id AND t.ts <= o.ts
  QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY t.ts DESC, t.turn_no DESC) = 1)
SELECT session_id, turn_no, uuid, count(*) AS calls FROM owned WHERE called < next_ts GROUP BY 1, 2, 3 HAVING count(*) >= 3
""",
    "read_before_edit": f"""
WITH c AS (SELECT session_id, id, coalesce(ts, TIMESTAMPTZ '0001-01-01 00:00:00+00') AS ts, tool_name, {_PATH} AS path FROM observations WHERE session_id IS NOT NULL),
l AS (SELECT *, {", ".join(f"lag(tool_name, {k}) OVER w AS t{k}, lag(path, {k}) OVER w AS p{k}" for k in (1, 2, 3))} FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ts, id))
SELECT session_id, count(*) AS edits, count_if({" OR ".join(f"coalesce(t{k} = 'Read' AND p{k} = path, false)" for k in (1, 2, 3))}) AS read_first FROM l WHERE tool_name IN ('Edit', 'Write') AND path <> '' GROUP BY session_id
""",
    "no_commit_sessions": f"SELECT session_id, count(*) AS shell_calls FROM (SELECT session_id, coalesce({_COMMAND}, '') AS command FROM observations WHERE tool_name = 'Bash' AND session_id IS NOT NULL) GROUP BY session_id HAVING count(*) >= 3 AND count_if(contains(command, 'git commit') OR contains(command, 'git push')) = 0",
    "tool_digests": f"WITH {_FIRST_CALLS} SELECT session_id, tool_name, calls, first_id, array_to_string(examples, chr(10)) AS examples FROM g",
    "confidence_fold": """
WITH s AS (SELECT session_id, id, NOT coalesce(regexp_matches(tool_response_summary, '^exit [1-9]'), false) AS hit FROM observations),
l AS (SELECT session_id, list(CASE WHEN hit THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY id) AS x, count_if(hit) AS hits, count(*) AS signals FROM s GROUP BY session_id)
SELECT session_id, hits, signals, list_reduce(list_prepend(0.5::DOUBLE, x), lambda a, b: CASE WHEN b = 1.0 THEN least(a + 0.05::DOUBLE, 0.9::DOUBLE) ELSE a - 0.05::DOUBLE END) AS confidence FROM l
""",
    "promoted_rules": "SELECT row_id, id, trigger, confidence, domain FROM instincts WHERE NOT coalesce(deprecated, false) AND confidence >= 0.7 ORDER BY confidence DESC, row_id LIMIT 30",
    "rules_document": f"""
WITH p AS (SELECT * FROM instincts WHERE NOT coalesce(deprecated, false) AND confidence >= 0.7 ORDER BY confidence DESC, row_id LIMIT 30)
SELECT '{RULES_HEAD}' || chr(10) || chr(10) || coalesce(string_agg('- **' || coalesce(trigger, id) || '** (confidence: ' || printf('%.2f', confidence) || ', domain: ' || coalesce(domain, '') || ')', chr(10) ORDER BY -confidence, id || '.md'), '') || chr(10) AS text FROM p
""",
    "similar_in_domain": _best("trim(a.domain) = trim(b.domain) AND trim(a.domain) <> ''", "trigger", "instincts"),
    "similar_any": _best("true", "trigger", "instincts"),
    "similar_by_keyword": _best("list_has_any(list_filter(list_transform(a.keywords, lambda k: lower(trim(k))), lambda k: k <> ''), list_transform(b.keywords, lambda k: lower(trim(k))))", "description", "memories"),
    "knn_l2": _knn("list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", ""),
    "knn_cosine": _knn("list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", "DESC"),
    "knn_live_only": _knn("list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", "", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25))"),
    "tfidf_recall": f"""
WITH docs AS (SELECT row_id AS id, coalesce(body, '') || ' ' || coalesce(array_to_string(keywords, ' '), '') AS text FROM memories UNION ALL SELECT -1, '{QUESTION}'),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_WORDS}) AS term FROM docs) GROUP BY id, term),
w AS (SELECT term, ln((SELECT count(*) + 1 FROM docs) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
v AS (SELECT id, term, tf * idf AS x FROM tf JOIN w USING (term)),
n AS (SELECT id, sqrt(sum(x * x)) AS size FROM v GROUP BY id),
d AS (SELECT a.id, sum(a.x * q.x) AS dot FROM v a JOIN v q ON q.id = -1 AND q.term = a.term WHERE a.id <> -1 GROUP BY a.id),
s AS (SELECT m.row_id AS id, round(coalesce(d.dot / (n.size * (SELECT size FROM n WHERE id = -1)), 0), 9) AS score FROM memories m LEFT JOIN d ON d.id = m.row_id LEFT JOIN n ON n.id = m.row_id)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""",
    "embed_cache_misses": """
WITH r AS (SELECT row_id, id AS memory_id, batch_no, sha256(coalesce(body, '') || ' ' || coalesce(array_to_string(keywords, ' '), '')) AS content_hash FROM memories WHERE id IS NOT NULL),
c AS (SELECT memory_id, arg_min(content_hash, row_id) AS known FROM r WHERE batch_no = 0 GROUP BY memory_id)
SELECT row_id, r.memory_id, content_hash FROM r LEFT JOIN c ON c.memory_id = r.memory_id WHERE known IS NULL OR known <> content_hash
""",
    "slug_ids": f"SELECT row_id, CASE WHEN regexp_full_match(coalesce(trim(id), ''), '[a-z0-9]+(-[a-z0-9]+)*') THEN left(trim(id), 80) ELSE {_slug('''coalesce(description, '')''')} END AS safe_id, {_slug('''coalesce(description, '')''')} AS slug FROM memories",
    "package_facts": " UNION ALL ".join(rf"SELECT session_id, '{m}' AS manager, count(*) AS calls FROM observations WHERE regexp_matches(coalesce(tool_input_json, ''), '\b{m}\b') GROUP BY session_id" for m in PACKAGE_MANAGERS),
    "claims": f"SELECT session_id, CASE WHEN lower(trim(coalesce(status, 'idle'))) <> 'processing' THEN 'take' WHEN updated_at IS NULL OR floor(epoch(TIMESTAMPTZ '{NOW}+00')) - floor(epoch(updated_at)) >= 600 THEN 'steal' ELSE 'refuse' END AS decision FROM session_progress",
    "orphan_sessions": f"SELECT session_id, last_processed_uuid FROM session_progress WHERE lower(trim(coalesce(status, 'idle'))) = 'processing' AND floor(epoch(TIMESTAMPTZ '{NOW}+00')) - floor(epoch(updated_at)) >= 600",
    "session_cursors": "SELECT session_id, max(id) AS last_processed_id FROM observations WHERE session_id IS NOT NULL GROUP BY session_id",
    "summary_due": f"WITH {_FIRST_LINES} SELECT session_id, count(*) AS new_turns FROM turns GROUP BY session_id HAVING count(*) >= 5",
    "recent_sessions": "SELECT session_id, updated_at AS last_exit_ts, left(coalesce(transcript_path, ''), 200) AS summary_excerpt FROM session_progress WHERE updated_at IS NOT NULL AND session_id <> '' ORDER BY updated_at DESC, session_id LIMIT 10",
}
SQL["detected_patterns"] = SQL["detected_patterns"].replace("{reads}", SQL["read_before_edit"]).replace("{commits}", SQL["no_commit_sessions"])


def _stripped(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _safe_id(candidate: str, fallback: str) -> str:
    return f"CASE WHEN regexp_full_match({_stripped(candidate)}, '[a-z0-9]+(-[a-z0-9]+)*') THEN left({_stripped(candidate)}, 80) ELSE {_slug(fallback)} END"


def _merge(store: str, candidates: str, text: str, gate: str, made: str, result: str) -> str:
    """A fold of candidates into a list of rows, as a recursion over candidates.

    Every row of the list and candidate has id, its text and ``ch``, the characters of it. ``gate`` of row x and
    candidate c says whether they may match; the most similar row from 0.45 on, the first of equals, is the match,
    else the row of the candidate's id. ``made`` is the row in place of ``old`` (null if there is none); it goes to
    the end.
    """
    score = f"list_transform(st, lambda x: CASE WHEN {gate} AND len(x.ch) > 0 AND len(c.ch) > 0 THEN len(list_intersect(x.ch, c.ch)) / (len(x.ch) + len(c.ch) - len(list_intersect(x.ch, c.ch))) ELSE -1.0 END)"
    return f"""
WITH RECURSIVE s AS ({store}), c0 AS ({candidates}), c AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM c0 WHERE {text} <> ''),
f(n, st) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(s ORDER BY s.id || '.md') FROM s)
  UNION ALL
  SELECT n, list_append(list_filter(st, lambda x, i: i <> coalesce(at_, 0)), made) FROM (
    SELECT n, st, at_, {made} AS made FROM (
      SELECT *, CASE WHEN at_ IS NOT NULL THEN st[at_] END AS old FROM (
        SELECT *, CASE WHEN list_max(sc) >= 0.45 THEN list_position(sc, list_max(sc)) ELSE nullif(coalesce(list_position(list_transform(st, lambda x: x.id), id), 0), 0) END AS at_
        FROM (SELECT f.st, c.*, {score} AS sc FROM f JOIN c ON c.n = f.n + 1)
      )
    )
  )
), r AS (SELECT unnest(st) AS x FROM f WHERE n = (SELECT count(*) FROM c))
SELECT {result} FROM r
"""


_NEXT = "least(coalesce(old.confidence, 0.5::DOUBLE) + 0.05::DOUBLE, 0.9::DOUBLE)"
_OF_BATCH_0 = "FROM {} WHERE batch_no = 0 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1"
SQL["instinct_merge"] = _merge(
    f"SELECT id, trigger, domain, confidence, hit_count, {_characters('trigger')} AS ch {_OF_BATCH_0.format('instincts')}",
    f"SELECT row_id AS seq, {_safe_id('id', _stripped('trigger'))} AS id, {_stripped('trigger')} AS trigger, {_stripped('domain')} AS domain, {_characters(_stripped('trigger'))} AS ch FROM instincts WHERE batch_no > 0",
    "trigger", f"c.domain <> '' AND c.domain = {_stripped('x.domain')}",
    f"{{'id': coalesce(CASE WHEN old IS NOT NULL THEN old.id END, id), 'trigger': trigger, 'domain': CASE WHEN domain <> '' THEN domain WHEN old IS NOT NULL THEN coalesce(old.domain, '') ELSE '' END, 'confidence': CASE WHEN old IS NULL THEN 0.5::DOUBLE ELSE {_NEXT} END, 'hit_count': CASE WHEN old IS NULL THEN 1::INTEGER ELSE (coalesce(old.hit_count, 0) + 1)::INTEGER END, 'ch': ch}}",
    "x.id AS id, x.trigger AS trigger, x.domain AS domain, x.confidence AS confidence, x.hit_count AS hit_count",
)
_KEYWORDS = r"list_filter(list_transform(coalesce(keywords, []), lambda k: lower(regexp_replace(coalesce(k, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))), lambda k: k <> '')"
SQL["fact_merge"] = _merge(
    f"SELECT id, type, description, created, {_KEYWORDS} AS kw, {_characters('description')} AS ch {_OF_BATCH_0.format('memories')}",
    f"SELECT row_id AS seq, {_safe_id('id', _stripped('description'))} AS id, coalesce(nullif(type, ''), 'project') AS type, {_stripped('description')} AS description, {_KEYWORDS} AS kw, {_characters(_stripped('description'))} AS ch FROM memories WHERE batch_no > 0",
    "description", "list_has_any(x.kw, c.kw)",
    "{'id': coalesce(CASE WHEN old IS NOT NULL THEN old.id END, id), 'type': type, 'description': description, 'created': DATE '2031-06-01', 'kw': kw, 'ch': ch}",
    "x.id AS id, x.type AS type, x.description AS description, x.created AS created",
)
_STATUS = "CASE WHEN old IS NULL OR old.status = 'deprecated' THEN 'candidate' ELSE coalesce(old.status, 'candidate') END"
_MOVED = "CASE WHEN good THEN least(coalesce(CASE WHEN old IS NOT NULL THEN old.confidence END, 0.5::DOUBLE) + 0.05::DOUBLE, 0.9::DOUBLE) ELSE coalesce(CASE WHEN old IS NOT NULL THEN old.confidence END, 0.5::DOUBLE) - 0.05::DOUBLE END"
_PROMOTED_NOW = f"({_STATUS}) <> 'promoted' AND ({_MOVED}) >= 0.7"
SQL["procedure_merge"] = _merge(
    f"SELECT id, trigger AS task_type, hit_count, confidence, CASE WHEN coalesce(deprecated, false) THEN 'deprecated' WHEN confidence >= 0.7 THEN 'promoted' ELSE 'candidate' END AS status, []::VARCHAR[] AS sessions, false AS promoted_now, {_characters('trigger')} AS ch {_OF_BATCH_0.format('instincts')}",
    f"SELECT row_id AS seq, {_safe_id('id', _stripped('trigger'))} AS id, {_stripped('trigger')} AS task_type, domain AS session, coalesce(hit_count, 0) >= 2 AS good, {_characters(_stripped('trigger'))} AS ch FROM instincts WHERE batch_no > 0 AND id IS NOT NULL",
    "task_type", "true",
    f"{{'id': coalesce(CASE WHEN old IS NOT NULL THEN old.id END, id), 'task_type': task_type, 'hit_count': (coalesce(CASE WHEN old IS NOT NULL THEN old.hit_count END, 0) + 1)::INTEGER, 'confidence': {_MOVED}, 'status': CASE WHEN {_PROMOTED_NOW} THEN 'promoted' ELSE {_STATUS} END, 'sessions': CASE WHEN coalesce(session, '') = '' OR list_contains(coalesce(CASE WHEN old IS NOT NULL THEN old.sessions END, []), session) THEN coalesce(CASE WHEN old IS NOT NULL THEN old.sessions END, []) ELSE list_append(coalesce(CASE WHEN old IS NOT NULL THEN old.sessions END, []), session) END, 'promoted_now': ({_PROMOTED_NOW}) OR coalesce(CASE WHEN old IS NOT NULL THEN old.promoted_now END, false), 'ch': ch}}",
    "x.id AS id, x.task_type AS task_type, x.hit_count AS hit_count, round(x.confidence, 9) AS confidence, x.status AS status, false AS skill_asked, array_to_string(x.sessions, ',') AS sessions, x.promoted_now AS promoted_now",
)
