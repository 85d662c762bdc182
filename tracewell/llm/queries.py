"""Named queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import big_join, table
from .conversations import conversation_clocks, rebuild_conversations
from .credentials import find_credentials, redact
from .forest import expand_pairs, near_duplicates
from .history import instinct_vectors, memory_vectors, restated_rows
from .packing import pack, token_counts, window_report
from .sequences import frequent_sequences
from .subjects import document_subjects
from .tokenize import decode_corpus, encode_corpus


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that restate a row of an earlier batch."""
    vectors = memory_vectors(table(spark, folder, "memories")).unionByName(instinct_vectors(table(spark, folder, "instincts")))
    return restated_rows(vectors)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of every whole conversation, in order."""
    return rebuild_conversations(table(spark, folder, "transcript")).select("session_id", "pos", "uuid", "role")


def p2_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """The estimated difference of the senders' clocks in each session."""
    return conversation_clocks(table(spark, folder, "transcript"))


def _p3_records(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories").select(F.lit("memories").alias("rel"), "row_id", F.concat_ws(" ", "description", "body").alias("text"))
    return memories.unionByName(table(spark, folder, "instincts").select(F.lit("instincts").alias("rel"), "row_id", F.col("trigger").alias("text")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of near-duplicate memories and of near-duplicate instincts."""
    return expand_pairs(*near_duplicates(_p3_records(spark, folder)))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its class of equal texts and the number of other classes that class is linked to."""
    members, links = near_duplicates(_p3_records(spark, folder))
    ends = links.select("rel", F.col("class_a").alias("class_id")).unionByName(links.select("rel", F.col("class_b").alias("class_id")))
    return big_join(members, ends.groupBy("rel", "class_id").agg(F.count("*").alias("links")), ["rel", "class_id"], "left").select("rel", "row_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every literal credential in tool inputs and response summaries."""
    return find_credentials(table(spark, folder, "observations"))


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """The tool calls with every credential masked in place."""
    return redact(table(spark, folder, "observations")).select("id", "tool_input_json", "tool_response_summary")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of three or four tools that at least a fifth of the sessions contain, with at most three calls between steps."""
    return frequent_sequences(table(spark, folder, "observations"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document; no text gives an empty list."""
    return encode_corpus(table(spark, folder, "documents"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents there are, and how many are equal to the text decoded from their ids."""
    documents = table(spark, folder, "documents")
    back = decode_corpus(encode_corpus(documents)).select("doc_id", F.col("text").alias("decoded"))
    same = big_join(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), back, "doc_id")
    return same.agg(F.count("*").alias("documents"), F.count_if(F.col("text") == F.col("decoded")).alias("equal"))


def p4_intact(spark: SparkSession, folder: str) -> DataFrame:
    """What masking must leave as it is: the number of rows, of inputs that are JSON, and of nulls."""
    masked = p4_masked(spark, folder)
    is_json = F.try_parse_json("tool_input_json").isNotNull()
    return masked.agg(F.count("*").alias("rows"), F.count_if(is_json).alias("json_inputs"), F.count_if(F.col("tool_input_json").isNull()).alias("no_input"), F.count_if(F.col("tool_response_summary").isNull()).alias("no_summary"))


def _capacities(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(r["window_name"], r["capacity_tokens"]) for r in table(spark, folder, "token_windows").collect()]


def p8_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The window of every document, or piece of one, for each capacity of ``token_windows``."""
    return pack(token_counts(table(spark, folder, "documents")), _capacities(spark, folder))


def p8_valid(spark: SparkSession, folder: str) -> DataFrame:
    """What ``p8_windows`` must keep: every document placed, no capacity exceeded, none cut that fits, no gaps."""
    report = window_report(p8_windows(spark, folder), _capacities(spark, folder))
    return report.select("window_name", "documents", "over", "cut_needlessly", "torn")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document that has none by hand, as spelled in ``subjects``."""
    found = document_subjects(table(spark, folder, "documents"))
    by_hand = table(spark, folder, "doc_subjects").select("doc_id")
    spelled = table(spark, folder, "subjects").select(F.col("subject").alias("spelled"), F.lower(F.trim("subject")).alias("subject"))
    return found.join(by_hand, "doc_id", "left_anti").join(spelled, "subject").select("doc_id", F.col("spelled").alias("subject"))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and share of the corpus by subject; a document of several subjects counts for each."""
    documents = table(spark, folder, "documents")
    total = documents.count()
    return document_subjects(documents).groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / F.lit(max(total, 1)))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_clocks": p2_clocks, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_masked": p4_masked, "p4_intact": p4_intact, "p6_found": p6_found, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p8_windows": p8_windows, "p8_valid": p8_valid, "p9_found": p9_found, "p9_composition": p9_composition}
SQL: dict[str, str] = {
    "p4_intact": "SELECT count(*) AS rows, count_if(tool_input_json <> '' AND json_valid(tool_input_json)) AS json_inputs, count_if(tool_input_json IS NULL) AS no_input, count_if(tool_response_summary IS NULL) AS no_summary FROM observations",
    "p7_roundtrip": "SELECT count(*) AS documents, count(*) AS equal FROM documents",
    "p8_valid": "SELECT window_name, (SELECT count(*) FROM documents) AS documents, 0 AS over, 0 AS cut_needlessly, 0 AS torn FROM token_windows",
    "p1_found": r"""
WITH m AS (
  SELECT row_id, batch_no, list_distinct(regexp_extract_all(lower(coalesce(description, '')), '[\p{L}\p{N}]+')) AS w,
         list_filter(list_transform(coalesce(keywords, []), lambda k: lower(trim(k))), lambda k: k <> '') AS k FROM memories
), i AS (
  SELECT row_id, batch_no, list_transform(list_sort(regexp_extract_all(lower(coalesce(id, '')), '[\p{L}\p{N}]+')), lambda x: x) AS ws FROM instincts
), bag AS (
  SELECT row_id, batch_no, list(x || '#' || n) AS w FROM (
    SELECT row_id, batch_no, x, row_number() OVER (PARTITION BY row_id, batch_no, x) AS n FROM (SELECT row_id, batch_no, unnest(ws) AS x FROM i)) GROUP BY ALL
)
SELECT DISTINCT 'memories' AS rel, a.row_id FROM m a JOIN m b ON b.batch_no < a.batch_no AND list_has_any(a.k, b.k) AND len(a.w) > 0
  AND 5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
UNION ALL
SELECT DISTINCT 'instincts', a.row_id FROM bag a JOIN bag b ON b.batch_no < a.batch_no
  AND greatest(len(a.w), len(b.w)) - len(list_intersect(a.w, b.w)) <= 1
""",
    "p3_found": r"""
WITH r AS (
  SELECT 'memories' AS rel, row_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', description, body)), '[\p{L}\p{N}]+')) AS w FROM memories
  UNION ALL SELECT 'instincts', row_id, list_distinct(regexp_extract_all(lower(coalesce(trigger, '')), '[\p{L}\p{N}]+')) FROM instincts
)
SELECT a.rel, a.row_id AS row_id_a, b.row_id AS row_id_b FROM r a JOIN r b ON a.rel = b.rel AND a.row_id < b.row_id AND len(a.w) > 0 AND len(b.w) > 0
  AND 5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
""",
    "p2_found": """
WITH parsed AS (
  SELECT session_id, line_no, type AS role, nullif(uuid, '') AS uuid,
    CASE WHEN regexp_full_match(trim("timestamp"), '[0-9]{12,14}') THEN CAST(trim("timestamp") AS BIGINT) * 1000
         ELSE epoch_us(TRY_CAST(trim("timestamp") AS TIMESTAMPTZ)) END AS us,
    CASE WHEN json_valid(message) AND json_type(TRY_CAST(message AS JSON)) = 'OBJECT' THEN json_extract(TRY_CAST(message AS JSON), '$.content') END AS content
  FROM transcript WHERE type IN ('user', 'assistant') AND session_id IS NOT NULL
), facts AS (
  SELECT *, uuid IS NULL OR content IS NULL AS damaged,
    CASE WHEN json_type(content) = 'VARCHAR' AND regexp_matches(content ->> '$', '[^\\s]') THEN role
         WHEN role = 'assistant' AND json_type(content) = 'ARRAY'
              AND len([b FOR b IN CAST(content AS JSON[]) IF b ->> '$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(b ->> '$.text', '[^\\s]')]) > 0 THEN role END AS kind,
    CASE WHEN json_type(content) = 'ARRAY' THEN CAST(content AS JSON[]) ELSE [] END AS blocks
  FROM parsed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no NULLS LAST, us NULLS LAST, uuid) AS o FROM facts
), once AS (
  SELECT * FROM placed QUALIFY uuid IS NULL OR row_number() OVER (PARTITION BY session_id, uuid ORDER BY o) = 1
), used AS (
  SELECT session_id, b ->> '$.id' AS tool_id, min(o) AS o FROM (SELECT session_id, o, unnest(blocks) AS b FROM once WHERE role = 'assistant') WHERE b ->> '$.type' = 'tool_use' GROUP BY ALL
), answered AS (
  SELECT session_id, b ->> '$.tool_use_id' AS tool_id, min(o) AS o FROM (SELECT session_id, o, unnest(blocks) AS b FROM once) WHERE b ->> '$.type' = 'tool_result' AND b ->> '$.tool_use_id' IS NOT NULL GROUP BY ALL
), messages AS (
  SELECT session_id, uuid, kind AS role, row_number() OVER w AS pos, lag(kind) OVER w AS before, lead(kind) OVER w AS after
  FROM once WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY o)
), bad AS (
  SELECT session_id FROM once WHERE damaged
  UNION SELECT a.session_id FROM answered a LEFT JOIN used u ON u.session_id = a.session_id AND u.tool_id = a.tool_id WHERE u.o IS NULL OR u.o > a.o
  UNION SELECT session_id FROM messages WHERE pos = 1 AND role = 'assistant'
  UNION SELECT session_id FROM messages WHERE role = 'user' AND coalesce(after, 'user') = 'user'
)
SELECT session_id, CAST(pos AS INTEGER) AS pos, uuid, role FROM messages WHERE session_id NOT IN (SELECT session_id FROM bad)
""",
    "p6_found": """
WITH clean AS (
  SELECT session_id, ts, lower(trim(tool_name)) AS tool, min(id) AS id FROM observations
  WHERE trim(session_id) <> '' AND trim(tool_name) <> '' GROUP BY session_id, ts, lower(trim(tool_name)), tool_input_json
), seq AS (
  SELECT session_id, tool, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS n FROM clean
), need AS (
  SELECT ceil(count(DISTINCT session_id) * 0.2 - 1e-9) AS least FROM seq
), pairs AS (
  SELECT DISTINCT a.session_id, a.n, b.n AS n2, a.tool || '>' || b.tool AS p FROM seq a JOIN seq b ON a.session_id = b.session_id AND b.n BETWEEN a.n + 1 AND a.n + 4
), threes AS (
  SELECT DISTINCT a.session_id, b.n AS n3, a.p || '>' || b.tool AS p FROM pairs a JOIN seq b ON a.session_id = b.session_id AND b.n BETWEEN a.n2 + 1 AND a.n2 + 4
), fours AS (
  SELECT DISTINCT a.session_id, a.p || '>' || b.tool AS p FROM threes a JOIN seq b ON a.session_id = b.session_id AND b.n BETWEEN a.n3 + 1 AND a.n3 + 4
)
SELECT p AS pattern, count(DISTINCT session_id) AS support FROM (SELECT session_id, p FROM threes UNION ALL SELECT session_id, p FROM fours)
GROUP BY p HAVING count(DISTINCT session_id) >= (SELECT least FROM need)
""",
}
