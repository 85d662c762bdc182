"""Deeply nested records as related flat tables (problem 5).

Every JSON value of a record becomes a node with an interval label: ``pre`` numbers the nodes in the
order a depth-first walk enters them, ``post`` in the order it leaves them. Node x contains node y
exactly if ``x.pre < y.pre and x.post > y.post``, so parent-child and ancestor-descendant links are
interval comparisons within one record, whatever its shape, and each node type can live in a table of
its own:

* ``shred``: one row a node, of all types; map-only, as a record never crosses a partition;
* ``object_nodes``: the node table of objects alone, at less cost;
* ``node_tables``: one table per type of stored nodes;
* ``linked``: each node with its nearest enclosing node of a type: a structural join, one pass over the labels
  sorted by (record, ``pre``) with a stack of the intervals that are open. It runs in the partition that
  shredded the record, so nothing is shuffled;
* ``enclosing``: the same between two node tables, wherever they lie: one shuffle on the record. A record is
  one row of the source, so no record is a hot key; the pass is linear and holds only the open intervals;
* ``object_links``: each object with the path of its nearest enclosing object.

Defined cases: null, empty, cut or otherwise malformed JSON has no nodes; a root that is not an object
has nodes in ``shred`` but no object links; rows with equal keys are records of their own; strings that hold JSON stay strings; of repeated keys in one object
the last counts, as in most parsers; nesting beyond the native parser's depth is parsed with an
explicit stack; a null key column is kept as null. Column names of the input other than the two named
are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("object", "array", "string", "number", "boolean", "null")
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_BLANK = re.compile(r"[ \t\n\r]*\Z")
_MISSING = object()


def _parse_deep(text: str) -> object:
    """JSON with an explicit stack, for nesting the native parser refuses. Raises ValueError if malformed."""
    stack: list[tuple[object, str | None]] = []
    value: object = _MISSING
    key: str | None = None
    want, at = "value", 0
    while True:
        if want == "end":
            if _BLANK.match(text, at):
                return value
            raise ValueError("trailing characters")
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("malformed")
        at = m.end()
        mark, string, number, word = m.groups()
        if want == "after":
            box = stack[-1][0]
            if mark == ",":
                want = "key" if isinstance(box, dict) else "value"
                continue
            if mark != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("malformed")
            value, key = stack.pop()
        elif want in ("key", "key or end"):
            if string:
                key, want = json.loads(string), ":"
                continue
            if want == "key" or mark != "}":
                raise ValueError("malformed")
            value, key = stack.pop()
        elif want == ":":
            if mark != ":":
                raise ValueError("malformed")
            want = "value"
            continue
        elif mark == "{" or mark == "[":
            stack.append(({} if mark == "{" else [], key))
            want = "key or end" if mark == "{" else "value or end"
            continue
        elif mark == "]" and want == "value or end":
            value, key = stack.pop()
        elif mark:
            raise ValueError("malformed")
        else:
            value = json.loads(string or number or word)
        if not stack:
            want = "end"
            continue
        box = stack[-1][0]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        want = "after"


def parse_json(text: str | None) -> object:
    """The value, or ``_MISSING`` if there is none."""
    if not text:
        return _MISSING
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _parse_deep(text)
        except ValueError:
            return _MISSING
    except ValueError:
        return _MISSING


def label(root: object) -> Iterator[tuple[str, object, int, int, int, str, str | None]]:
    """(kind, scalar, pre, post, level, path, name) of every node, in order of ``post``."""
    pre = post = 0
    stack = [(root, 0, 0, "$", None, None)]  # value, own pre, level, path, name, children left
    while stack:
        value, mine, level, path, name, left = stack[-1]
        if left is None:
            mine, pre = pre, pre + 1
            if isinstance(value, dict):
                left = ((v, f"{path}.{k}", k) for k, v in value.items())
            elif isinstance(value, list):
                left = ((v, f"{path}[{k}]", None) for k, v in enumerate(value))
            else:
                left = iter(())
            stack[-1] = (value, mine, level, path, name, left)
        child = next(left, None)
        if child is not None:
            stack.append((child[0], 0, level + 1, child[1], child[2], None))
            continue
        stack.pop()
        if isinstance(value, dict):
            kind, scalar = "object", None
        elif isinstance(value, list):
            kind, scalar = "array", None
        elif isinstance(value, str):
            kind, scalar = "string", value
        elif isinstance(value, bool):
            kind, scalar = "boolean", "true" if value else "false"
        elif value is None:
            kind, scalar = "null", None
        else:
            kind, scalar = "number", repr(value)
        yield kind, scalar, mine, post, level, path, name
        post += 1


def labels_of(text: str | None) -> Iterator[tuple[str, object, int, int, int, str, str | None]]:
    """``label`` of JSON text; nothing if there is none. ``_MISSING`` is compared here, as a copy sent to a worker is another object."""
    root = parse_json(text)
    return iter(()) if root is _MISSING else label(root)


def _object_labels(root: dict) -> list[tuple[int, int, str]]:
    """(pre, post, path) of the objects alone, the root first; numbered as among all containers."""
    out: list[list] = [[0, 0, "$"]]
    entered, left = 1, 0
    stack: list[tuple] = [(0, iter([(f"$.{k}", v) for k, v in root.items() if v.__class__ is dict or v.__class__ is list]))]
    while stack:
        slot, children = stack[-1]
        for path, value in children:
            if value.__class__ is dict:
                out.append([entered, 0, path])
                stack.append((len(out) - 1, iter([(f"{path}.{k}", v) for k, v in value.items() if v.__class__ is dict or v.__class__ is list])))
            else:
                stack.append((-1, iter([(f"{path}[{k}]", v) for k, v in enumerate(value) if v.__class__ is dict or v.__class__ is list])))
            entered += 1
            break
        else:
            stack.pop()
            if slot >= 0:
                out[slot][1] = left
            left += 1
    return out


class _Intervals:
    """The open intervals of one record; nodes must come in order of ``pre``."""

    def __init__(self) -> None:
        self.record, self.open = None, []

    def around(self, record: object, post: int) -> tuple[int, int, str] | None:
        """(pre, post, path) of the nearest open interval that ends after ``post``."""
        if record != self.record:
            self.record, self.open = record, []
        while self.open and self.open[-1][1] < post:  # it ended before this node: no containment
            self.open.pop()
        return self.open[-1] if self.open else None


def nearest_containing(labels: list[tuple[int, int, str]]) -> Iterator[tuple[str, str]]:
    """(path of the nearest containing interval, path) for labels (pre, post, path) of one record sorted by ``pre``."""
    intervals = _Intervals()
    for node in labels:
        parent = intervals.around(0, node[1])
        if parent:
            yield parent[2], node[2]
        intervals.open.append(node)


def _structural_join(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record, pre), of which those marked ``is_parent`` open intervals, with parent_pre and parent_path; only those marked ``is_child`` stay."""
    intervals = _Intervals()
    for batch in batches:
        record, pre, post, path, child, parent = (batch.column(names.index(c)).to_pylist() for c in ("record", "pre", "post", "path", "is_child", "is_parent"))
        pres, paths = [], []
        for i, r in enumerate(record):
            found = intervals.around(r, post[i])
            pres.append(found[0] if found else None)
            paths.append(found[2] if found else None)
            if parent[i]:
                intervals.open.append((pre[i], post[i], path[i]))
        keep = pa.array(child)
        columns = [*batch.columns, pa.array(pres, pa.int32()), pa.array(paths, pa.string())]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[*names, "parent_pre", "parent_path"])


def _joined(marked: DataFrame) -> DataFrame:
    names = marked.columns
    schema = T.StructType([*marked.schema.fields, T.StructField("parent_pre", T.IntegerType()), T.StructField("parent_path", T.StringType())])
    ordered = marked.sortWithinPartitions("record", "pre", F.col("is_parent"))
    return ordered.mapInArrow(lambda batches: _structural_join(batches, names), schema).drop("is_child", "is_parent")


def linked(nodes: DataFrame, parents: str = "object") -> DataFrame:
    """``nodes``, straight from ``shred`` or ``object_nodes``, with parent_pre and parent_path: the nearest enclosing node of the type ``parents``; null if there is none."""
    is_parent = F.col("kind") == parents if "kind" in nodes.columns else F.lit(True)
    return _joined(nodes.withColumns({"is_child": F.lit(True), "is_parent": is_parent}))


def _records_of(df: DataFrame, key_column: str, json_column: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("record"), F.col(key_column).alias("row_key"), F.col(json_column).alias("json"))


def _nodes(df: DataFrame, key_column: str, json_column: str, fields: list[T.StructField], labels: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """(record, row_key, fields) of the labels of every record."""
    schema = T.StructType([T.StructField("record", T.LongType()), T.StructField("row_key", df.schema[key_column].dataType), *fields])
    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, rows = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    before = len(rows)
                    rows += labels(text)
                    owner += [i] * (len(rows) - before)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), *columns], names=schema.fieldNames())

    return _records_of(df, key_column, json_column).mapInArrow(run, schema)


def shred(df: DataFrame, key_column: str, json_column: str) -> DataFrame:
    """(record, row_key, kind, value, pre, post, level, path, name): one row for every node of every record."""
    fields = [T.StructField(n, T.IntegerType() if n in ("pre", "post", "level") else T.StringType()) for n in ("kind", "value", "pre", "post", "level", "path", "name")]
    return _nodes(df, key_column, json_column, fields, labels_of)


def object_nodes(df: DataFrame, key_column: str, json_column: str) -> DataFrame:
    """(record, row_key, pre, post, path): the objects of every record whose root is one."""

    def labels(text: str | None) -> Iterable[tuple]:
        root = parse_json(text)
        return _object_labels(root) if root.__class__ is dict else ()

    fields = [T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType()), T.StructField("path", T.StringType())]
    return _nodes(df, key_column, json_column, fields, labels)


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per node type, with typed values; each keeps the interval label and the record's key."""
    label_columns = ["record", "row_key", "pre", "post", "level", "path", "name"]
    typed = {"string": F.col("value"), "number": F.col("value").cast("double"), "boolean": F.col("value").cast("boolean")}
    return {kind: nodes.filter(F.col("kind") == kind).select(*label_columns, *([typed[kind].alias("value")] if kind in typed else [])) for kind in KINDS}


def enclosing(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with parent_pre and parent_path: the nearest node of ``parents`` around each child; null if there is none."""
    marks = {"is_child": F.lit(True), "is_parent": F.lit(False)}
    opened = parents.select("record", "pre", "post", "path").withColumns({"is_child": F.lit(False), "is_parent": F.lit(True)})
    return _joined(children.withColumns(marks).unionByName(opened, allowMissingColumns=True).repartition("record"))


def object_links(df: DataFrame, key_column: str, json_column: str) -> DataFrame:
    """(row_key, parent_path, child_path) for each object below the root of a record that is an object."""
    # an object below the root needs a second opening brace: others are not handed to Python
    has_two = F.col(json_column).rlike(r"(?s)^\s*\{.*\{")
    links = linked(object_nodes(df.filter(has_two), key_column, json_column))
    return links.filter(F.col("parent_path").isNotNull()).select("row_key", "parent_path", F.col("path").alias("child_path"))


def first_copy(df: DataFrame, key_column: str, order: list[str], value_column: str) -> DataFrame:
    """One row a key: the value of its first row by ``order``, nulls last. Copies are combined before the shuffle."""
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], F.col(value_column))
    return df.groupBy(key_column).agg(F.min_by(F.col(value_column), place).alias(value_column))
