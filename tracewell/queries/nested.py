"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import first_copy, linked, object_links, shred
from ..runtime import table


def _records(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str, str]]:
    lines = table(spark, folder, "transcript").select("uuid", "session_id", "line_no", "timestamp", "message").filter((F.col("uuid") != "") & F.col("message").isNotNull())
    calls = table(spark, folder, "observations").select(F.col("id").cast("string").alias("id"), "tool_input_json")
    return {"transcript": (first_copy(lines, "uuid", ["session_id", "line_no", "timestamp"], "message"), "uuid", "message"), "observations": (calls, "id", "tool_input_json")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each JSON object below a root object, with its nearest enclosing object."""
    parts = [object_links(df, key, value).select(F.lit(rel).alias("rel"), "row_key", "parent_path", "child_path") for rel, (df, key, value) in _records(spark, folder).items()]
    return parts[0].unionByName(parts[1])


def p5_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of a message or tool input with its kind, name, level, value and nearest object, linked by containment.

    ``value`` is the text of a scalar as parsed, exact for any number. A root object, and nodes that no object
    encloses, have no parent.
    """
    parts = []
    for rel, (df, key, value) in _records(spark, folder).items():
        links = linked(shred(df, key, value))
        parts.append(links.select(F.lit(rel).alias("rel"), "row_key", "parent_pre", "parent_path", F.col("pre").alias("child_pre"), F.col("path").alias("child_path"), "kind", "level", "name", "value"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p5_found": p5_found, "p5_tables": p5_tables}
_ROOTS = """
roots AS (
  SELECT 'transcript' AS rel, uuid AS row_key, arg_min(message, (CASE WHEN line_no IS NULL THEN 1 ELSE 0 END, session_id, coalesce(line_no, 0), coalesce("timestamp", ''), message)) AS j
  FROM transcript WHERE uuid IS NOT NULL AND uuid <> '' AND message IS NOT NULL GROUP BY uuid
  UNION ALL SELECT 'observations', CAST(id AS VARCHAR), tool_input_json FROM observations
)
"""
SQL: dict[str, str] = {
    "p5_found": f"WITH RECURSIVE {_ROOTS}" + """, valid AS (
  SELECT rel, row_key, CAST(j AS JSON) AS j FROM roots WHERE json_valid(j) AND json_type(TRY_CAST(j AS JSON)) = 'OBJECT'
), node(rel, row_key, kind, j, path, parent) AS (
  SELECT rel, row_key, 'OBJECT', j, '$', CAST(NULL AS VARCHAR) FROM valid
  UNION ALL
  SELECT rel, row_key, json_type(c.v), c.v, c.p, parent FROM (
    SELECT rel, row_key, CASE WHEN kind = 'OBJECT' THEN path ELSE parent END AS parent,
      unnest(CASE WHEN kind = 'OBJECT' THEN [{'v': x[1], 'p': path || '.' || x[2]} FOR x IN list_transform(json_keys(j), lambda k: (json_extract(j, '$."' || k || '"'), k))]
             ELSE [{'v': json_extract(j, '$[' || i || ']'), 'p': path || '[' || i || ']'} FOR i IN range(CAST(json_array_length(j) AS BIGINT))] END) AS c
    FROM node WHERE kind IN ('OBJECT', 'ARRAY'))
)
SELECT rel, row_key, parent AS parent_path, path AS child_path FROM node WHERE kind = 'OBJECT' AND path <> '$'
""",
    "p5_tables": f"WITH RECURSIVE {_ROOTS}" + """, valid AS MATERIALIZED (
  SELECT rel, row_key, j FROM roots WHERE j <> '' AND json_valid(j)
), tree AS (
  SELECT rel, row_key, t.id, t.parent, t.key, t.type, CASE WHEN t.type = 'VARCHAR' THEN t.value ->> '$' WHEN t.type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL WHEN t.type = 'DOUBLE' THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE CAST(t.atom AS VARCHAR) END AS value,
    CAST(row_number() OVER (PARTITION BY rel, row_key ORDER BY t.id) - 1 AS INTEGER) AS pre
  FROM valid, json_tree(valid.j) t
), node(rel, row_key, id, pre, type, path, name, level, value, parent_pre, parent_path) AS (
  SELECT rel, row_key, id, pre, type, '$', CAST(NULL AS VARCHAR), 0, value, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT c.rel, c.row_key, c.id, c.pre, c.type, p.path || CASE WHEN p.type = 'OBJECT' THEN '.' || c.key ELSE '[' || c.key || ']' END, CASE WHEN p.type = 'OBJECT' THEN c.key END, p.level + 1, c.value,
    CASE WHEN p.type = 'OBJECT' THEN p.pre ELSE p.parent_pre END, CASE WHEN p.type = 'OBJECT' THEN p.path ELSE p.parent_path END
  FROM node p JOIN tree c ON c.rel = p.rel AND c.row_key = p.row_key AND c.parent = p.id
)
SELECT rel, row_key, parent_pre, parent_path, pre AS child_pre, path AS child_path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, level, name, value FROM node
""",
}
