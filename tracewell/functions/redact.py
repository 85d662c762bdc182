"""Redaction of secrets in text, nested values and whole records, and the sensitive-path rules.

Everything with a known type is a Spark expression; only JSON of unknown shape goes through Arrow.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands in place of a secret, and of the content of a sensitive file.
MASK = "***REDACTED***"
SENSITIVE_MASK = "<REDACTED: sensitive file>"
#: Fixed values, applied in this order.
PATTERNS = (
    r"sk-[A-Za-z0-9]{20,}",
    r"ark-[A-Za-z0-9-]{20,}",
    r"(?i)(api[_-]?key|token|password)\s*[:=]\s*\S+",
    r"ghp_[A-Za-z0-9]{36,}",
    r"AKIA[A-Z0-9]{16}",
    r"(?i)Bearer\s+[A-Za-z0-9\-_.]+",
)
#: A scheme word after the separator does not end the secret (``token: Bearer x``); only with strict.
STRICT_PATTERN = r"(?i)(api[_-]?key|token|password)\s*[:=]\s*(Bearer|Basic)\s+\S+"
#: Parts of sensitive paths, and the names of fields that hold paths, by priority.
SENSITIVE_PARTS = (".env", ".pem", ".key", "id_rsa", ".npmrc", ".aws", "credentials", "secrets")
PATH_FIELDS = ("file_path", "path", "notebook_path", "filename")


def _java(pattern: str) -> str:
    """Blanks and letters as in Unicode, like Python; DuckDB and plain Java know ASCII only."""
    return pattern.replace("(?i)", "(?iU)") if "(?i)" in pattern else pattern


def _order(strict: bool) -> tuple[str, ...]:
    return (STRICT_PATTERN, *PATTERNS) if strict else PATTERNS


def redact_text(c: str | Column, strict: bool = False) -> Column:
    """The text with every match of the patterns masked, one pattern after the other."""
    out = F.col(c) if isinstance(c, str) else c
    for pattern in _order(strict):
        out = F.regexp_replace(out, F.lit(_java(pattern)), F.lit(MASK))
    return out


def redact_value(c: Column, kind: T.DataType, strict: bool = False) -> Column:
    """A typed nested value with all its strings redacted; map keys and other types stay."""
    if isinstance(kind, T.StringType):
        return redact_text(c, strict)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_value(x, kind.elementType, strict))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: redact_value(v, kind.valueType, strict))
    if isinstance(kind, T.StructType):
        fields = [redact_value(c.getField(f.name), f.dataType, strict).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    return c


def redact_json(c: str | Column, strict: bool = False) -> Column:
    """JSON of unknown shape with all its string values redacted; text that is not JSON is redacted as text."""
    patterns = [re.compile(p) for p in _order(strict)]

    def clean(text: str) -> str:
        for p in patterns:
            text = p.sub(MASK, text)
        return text

    def walk(value: object) -> object:
        if isinstance(value, str):
            return clean(value)
        if isinstance(value, list):
            return [walk(x) for x in value]
        return {k: walk(v) for k, v in value.items()} if isinstance(value, dict) else value

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(walk(json.loads(text)), ensure_ascii=False)
            except (ValueError, RecursionError):
                return clean(text)

        return texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)

    return run(c)


def is_sensitive_path(c: str | Column) -> Column:
    """Whether the lower-cased path contains a sensitive part; null and empty paths do not."""
    path = F.lower(F.col(c) if isinstance(c, str) else c)
    found = F.lit(False)
    for part in SENSITIVE_PARTS:
        found = found | path.contains(part)
    return F.coalesce(found, F.lit(False))


def first_path(c: str | Column) -> Column:
    """The first path in JSON: by priority of the field at each level, then depth first; lists are not entered."""

    def search(value: object) -> str | None:
        if not isinstance(value, dict):
            return None
        here = next((value[k] for k in PATH_FIELDS if isinstance(value.get(k), str)), None)
        if here is not None:
            return here
        return next((p for p in map(search, value.values()) if p), None)

    @F.pandas_udf("string")
    def deep(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return search(json.loads(text)) if text else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one, na_action="ignore").astype(object)

    text = F.col(c) if isinstance(c, str) else c
    return F.when(text.rlike(r'"(?:' + "|".join(PATH_FIELDS) + r')"'), deep(text))


def sensitive_path(*content: str | Column) -> Column:
    """The first sensitive path among the first paths of the content columns, in their order; null if there is none."""
    paths = [first_path(c) for c in content]
    return F.coalesce(*[F.when(is_sensitive_path(p), p) for p in paths])


def mask_records(df: DataFrame, path: Column, content: list[str], strict: bool = False) -> DataFrame:
    """Records about a sensitive file lose their content columns and name the file; others are redacted.

    A masked record keeps its other columns as they are. ``file`` is null for the others.
    """
    marked = df.withColumn("file", F.when(is_sensitive_path(path), path))
    masked = F.col("file").isNotNull()
    columns = {}
    for f in df.schema.fields:
        if f.name in content:
            columns[f.name] = F.when(masked, F.lit(SENSITIVE_MASK)).otherwise(redact_json(f.name, strict) if f.name.endswith("_json") else redact_text(f.name, strict))
        elif isinstance(f.dataType, (T.StringType, T.StructType, T.ArrayType, T.MapType)) and f.name != "tool_name":
            columns[f.name] = F.when(masked, F.col(f.name)).otherwise(redact_value(F.col(f.name), f.dataType, strict))
    return marked.withColumns(columns)
