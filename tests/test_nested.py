import json
import os
import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from support import DATA
from tracewell.operators import nested
from tracewell.queries.nested import p5_found, p5_tables


def walk(v, path="$", parent=None):
    if isinstance(v, dict):
        if parent:
            yield parent, path
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}", path)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]", parent)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=2), c, max_size=3), max_leaves=15)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_labels_are_nested_intervals(value):
    nodes = list(nested.label(value))
    assert sorted(n[2] for n in nodes) == list(range(len(nodes))) == [n[3] for n in nodes]
    for a in nodes:
        for b in nodes:
            inside = b[5] != a[5] and b[5].startswith(a[5]) and b[5][len(a[5])] in ".["
            assert inside == (a[2] < b[2] and a[3] > b[3])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=2), JSON, max_size=4))
def test_object_links(value):
    assert sorted(nested.nearest_containing(nested._object_labels(value))) == sorted(walk(value))


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_deep_parser_reads_json(value):
    assert nested._parse_deep(json.dumps(value)) == value
    assert nested._parse_deep(" " + json.dumps(value, indent=1) + "\n") == value


def test_deep_parser_refuses_what_is_not_json():
    for text in ("", "{", "[1,]", "{1:2}", '{"a" 1}', "[1] 2", "[1 2]", "{,}", "nul", '{"a":1,}'):
        try:
            nested._parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


ROWS = [("a", json.dumps({"x": {"y": [{"z": 1}, [{"w": {}}]]}, "s": '{"no": {}}'})), ("b", '{"cut": {'), ("c", None), ("d", ""), ("e", "[{}]"), (None, '{"q": {}}'), ("f", '{"p": {}, "p": 1}'), ("g", '"{}"')]


def test_found_links(spark):
    df = spark.createDataFrame(ROWS, "k string, j string").withColumn("row_key", F.lit("clash")).withColumn("json", F.lit(1))
    got = {tuple(r) for r in nested.object_links(df, "k", "j").collect()}
    assert got == {("a", "$", "$.x"), ("a", "$.x", "$.x.y[0]"), ("a", "$.x", "$.x.y[1][0]"), ("a", "$.x.y[1][0]", "$.x.y[1][0].w"), (None, "$", "$.q")}
    assert nested.object_links(df.limit(0), "k", "j").count() == 0


def test_very_deep_records(spark):
    deep = '{"a":' * 60_000 + "{}" + "}" * 60_000
    df = spark.createDataFrame([("k", '{"a":' * 3000 + "{}" + "}" * 3000)], "k string, j string")
    assert nested.object_links(df, "k", "j").count() == 3000
    assert nested.parse_json(deep) is not nested._MISSING


def test_tables_linked_by_containment(spark):
    r = random.Random(4)

    def make(d):
        x = r.random()
        if d > 4 or x < 0.3:
            return r.choice([1, 2.5, "s", True, None])
        return {r.choice("abc"): make(d + 1) for _ in range(3)} if x < 0.7 else [make(d + 1) for _ in range(2)]

    rows = [(i, json.dumps({"r": make(0)})) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, j string")
    tables = nested.node_tables(nested.shred(df, "k", "j"))
    links = {(x["row_key"], x["parent_path"], x["path"]) for x in nested.enclosing(tables["object"], tables["object"]).collect() if x["parent_path"]}
    assert links == {(i, p, c) for i, t in rows for p, c in walk(json.loads(t))}
    assert {t.count() > 0 for t in tables.values()} == {True}
    assert tables["number"].schema["value"].dataType.typeName() == "double"


def test_first_copy(spark):
    df = spark.createDataFrame([("u", None, "late"), ("u", 2, "b"), ("u", 1, "a"), ("v", None, None)], "u string, n int, m string")
    assert {tuple(r) for r in nested.first_copy(df, "u", ["n"], "m").collect()} == {("u", "a"), ("v", None)}


def flat(v, path="$", parent=None, name=None, level=0):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    yield parent, path, kind, level, name, {"string": v, "boolean": str(v).lower(), "number": repr(v)}.get(kind)
    if isinstance(v, dict):
        for k, x in v.items():
            yield from flat(x, f"{path}.{k}", path, k, level + 1)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from flat(x, f"{path}[{i}]", parent, None, level + 1)


def test_nodes_without_parent_stay(spark):
    texts = {"a": '{"n": null, "x": {"y": [1, {"z": false}]}, "big": 12345678901234567890}', "b": '[1, {"q": "s"}]', "c": "7", "d": "{cut"}
    nodes = nested.shred(spark.createDataFrame(list(texts.items()), "k string, j string"), "k", "j")
    expected = {(k, *x) for k, t in texts.items() if k != "d" for x in flat(json.loads(t))}
    columns = ("row_key", "parent_path", "path", "kind", "level", "name", "value")
    for links in (nested.linked(nodes), nested.enclosing(nodes, nested.node_tables(nodes)["object"])):
        assert {tuple(r) for r in links.select(*columns).collect()} == expected


def test_equal_and_null_keys_are_records_of_their_own(spark):
    df = spark.createDataFrame([("k", '{"a": {"b": {}}}'), ("k", '{"c": [{}]}'), (None, '{"d": {}}')], "k string, j string")
    expected = sorted([("k", "$", "$.a"), ("k", "$.a", "$.a.b"), ("k", "$", "$.c[0]"), (None, "$", "$.d")], key=repr)
    assert sorted((tuple(r) for r in nested.object_links(df, "k", "j").collect()), key=repr) == expected
    nodes = nested.shred(df, "k", "j")
    arrays = nested.enclosing(nodes.filter("kind = 'object'"), nodes.filter("kind = 'array'")).filter("parent_path is not null")
    assert [(r["row_key"], r["parent_path"], r["path"]) for r in arrays.collect()] == [("k", "$.c", "$.c[0]")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_tables_hold_every_node_of_both_relations(spark):
    rows = p5_tables(spark, DATA).collect()
    calls = {(str(r["id"]), *x) for r in pq.read_table(f"{DATA}/observations.parquet").to_pylist() for v in [nested.parse_json(r["tool_input_json"])] if v is not nested._MISSING for x in flat(v)}
    assert {(r["row_key"], *[r[c] for c in ("parent_path", "child_path", "kind", "level", "name", "value")]) for r in rows if r["rel"] == "observations"} == calls
    assert {r["kind"] for r in rows} == set(nested.KINDS)
    links = {(r["rel"], r["row_key"], r["parent_path"], r["child_path"]) for r in rows if r["kind"] == "object" and r["parent_path"]}
    assert {tuple(r) for r in p5_found(spark, DATA).collect()} <= links
    place = lambda r: [x for c in ("session_id", "line_no", "timestamp", "message") for x in (r[c] is None, r[c] or (0 if c == "line_no" else ""))]
    first = {}
    for r in sorted((r for r in pq.read_table(f"{DATA}/transcript.parquet").to_pylist() if r["uuid"] and r["message"] is not None), key=place):
        first.setdefault(r["uuid"], r["message"])
    messages = {(u, *x) for u, t in first.items() for v in [nested.parse_json(t)] if v is not nested._MISSING for x in flat(v)}
    assert {(r["row_key"], *[r[c] for c in ("parent_path", "child_path", "kind", "level", "name", "value")]) for r in rows if r["rel"] == "transcript"} == messages
