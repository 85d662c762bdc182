"""Entity files: one Markdown file a row, with a YAML-like head (format ``frontmatter``).

The head is read with the subset of YAML such files use: scalars, quoted strings, lists in block and flow
form, and texts folded over indented lines. Unknown keys survive in ``extra``; a missing id is the file's
name. As a Python data source it plans one partition for each group of files and reads them on executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KEY = re.compile(r"([A-Za-z_][\w-]*):(?:[ \t]+(.*))?$")


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        inner = text[1:-1].strip()
        return [_scalar(x) for x in re.findall(r"'(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,\s][^,]*", inner)] if inner else []
    if text in ("", "~", "null"):
        return None if text else ""
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?\d*\.\d+(?:[eE][-+]?\d+)?", text):
        return float(text)
    return text


def parse_frontmatter(text: str) -> tuple[dict[str, object], str]:
    """(head, body); a file without a head is all body."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return {}, text.strip()
    end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    head: dict[str, object] = {}
    key, parts = None, []

    def close() -> None:
        if key is not None:
            if parts and all(p.startswith("- ") or p == "-" for p in parts):
                head[key] = [_scalar(p[1:]) for p in parts]
            else:
                head[key] = _scalar(" ".join(parts))

    for line in lines[1:end]:
        m = _KEY.match(line)
        if m:
            close()
            key, parts = m.group(1), [m.group(2).strip()] if m.group(2) else []
        elif key is not None and line.strip():
            parts.append(line.strip())
    close()
    return head, "\n".join(lines[end + 1 :]).strip()


def format_frontmatter(head: dict[str, object], body: str) -> str:
    """The text of one entity file; keys in alphabetical order."""

    def scalar(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        text = str(v)
        plain = re.fullmatch(r"[^\s'\"\[\]{}#&*!|>%@`,:?-][^\n'\"\[\]{}#:]*", text) and _scalar(text) == text
        return text if plain else "'" + text.replace("\n", " ").replace("'", "''") + "'"

    out = ["---"]
    for key in sorted(head):
        value = head[key]
        if isinstance(value, (list, tuple)):
            out += [f"{key}:" if value else f"{key}: []", *[f"- {scalar(v)}" for v in value]]
        else:
            out.append(f"{key}: {scalar(value)}")
    return "\n".join([*out, "---", "", body or ""]).rstrip("\n") + "\n"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.group = options["path"], int(options.get("filesPerPartition", "500"))

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".md")) if os.path.isdir(self.folder) else []
        paths = [os.path.join(self.folder, n) for n in names]
        return [_Files(paths[i : i + self.group]) for i in range(0, len(paths), self.group)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, encoding="utf-8") as f:
                head, body = parse_frontmatter(f.read())
            stem = os.path.basename(path)[: -len(".md")]
            yield str(head.get("id") or stem), stem, json.dumps(head, ensure_ascii=False, default=str), body


class FrontmatterSource(DataSource):
    """``spark.read.format("frontmatter").load(folder)`` -> (id, file, head JSON, body)."""

    @classmethod
    def name(cls) -> str:
        return "frontmatter"

    def schema(self) -> str:
        return "id string, file string, head string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read_entities(spark: SparkSession, folder: str, schema) -> DataFrame:  # noqa: ANN001
    """Entity rows of a folder in a fixed schema; keys that are missing are null, a missing folder has no rows."""
    from pyspark.sql import functions as F

    spark.dataSource.register(FrontmatterSource)
    head = [f for f in schema.fields if f.name not in ("id", "body")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head)
    rows = spark.read.format("frontmatter").load(folder).withColumn("h", F.from_json("head", ddl))
    return rows.select(*[F.col(f.name) if f.name in ("id", "body") else F.col(f"h.{f.name}").alias(f.name) for f in schema.fields])
