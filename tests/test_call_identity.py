"""Sensitive and repeated calls against a plain fold, in any layout of the input."""

import json

import pyarrow.parquet as pq
import pytest

from support import DATA
from tracewell.functions.redact import SENSITIVE_PARTS
from tracewell.queries import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    """The calls of the test tables, and some of the ways to write one call."""
    odd = [("Read", '{"path": "/a/.env"}'), ("NotebookEdit", '{"notebook_path": "/a/secrets.ipynb"}'), ("Read", '{"opts": {"filename": "id_rsa"}}'), ("Read", '{"a": 1, "b": 2}'), ("Read", '{"b":2,"a":1}'), ("Read", "{cut"), ("Read", None), ("Read", "{}")]
    made = spark.createDataFrame([(10_000_000 + i, "s", "2031-03-01 00:00:00", t, j) for i, (t, j) in enumerate(odd)], "id long, session_id string, at string, tool_name string, tool_input_json string").selectExpr("id", "session_id", "CAST(at AS TIMESTAMP) AS ts", "tool_name", "tool_input_json", "CAST(NULL AS STRING) AS tool_response_summary")
    spark.read.parquet(f"{DATA}/observations.parquet").select(made.columns).unionByName(made).write.parquet(f"{tmp_path}/observations.parquet")
    return str(tmp_path)


def read(text):
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


def path_in(value):
    if not isinstance(value, dict):
        return None
    here = [value[k] for k in ("file_path", "path", "notebook_path", "filename") if isinstance(value.get(k), str)]
    return here[0] if here else next((p for p in map(path_in, value.values()) if p), None)


def test_sensitive_calls_look_at_every_path_field(spark, folder):
    rows = pq.read_table(f"{folder}/observations.parquet").to_pylist()
    want = {(r["id"], p) for r in rows for p in [path_in(read(r["tool_input_json"]))] if p and any(part in p.lower() for part in SENSITIVE_PARTS)}
    assert {tuple(r) for r in QUERIES["sensitive_calls"](spark, folder).collect()} == want
    assert {i for i, _ in want if i >= 10_000_000} == {10_000_000, 10_000_001, 10_000_002}


def test_repeated_calls_in_another_layout_go(spark, folder):
    def key(r):
        text = "{}" if r["tool_input_json"] is None else r["tool_input_json"]
        try:
            text = json.dumps(json.loads(text), sort_keys=True)
        except ValueError:
            pass
        return r["tool_name"] or "", text

    last, want = {}, set()
    rows = pq.read_table(f"{folder}/observations.parquet").to_pylist()
    for r in sorted(rows, key=lambda r: (r["ts"] is not None, r["ts"] and r["ts"].timestamp(), r["id"])):
        if r["ts"] is None:
            want.add(r["id"])
        elif key(r) not in last or (r["ts"] - last[key(r)]).total_seconds() >= 300:
            last[key(r)] = r["ts"]
            want.add(r["id"])
    got = {r["id"] for r in QUERIES["dedup_calls"](spark, folder).collect()}
    assert got == want and 10_000_003 in got and 10_000_004 not in got and 10_000_007 not in got
