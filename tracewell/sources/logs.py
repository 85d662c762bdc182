"""Scans of events, transcripts, JSON tables and documents; missing or broken input is empty, not an error."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "session_id STRING, ts STRING, tool_name STRING, tool_input VARIANT, tool_response VARIANT"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON events, one an object on a line; a null input becomes an empty object, other lines are dropped."""
    lines = (spark.readStream if stream else spark.read).format("text").load(path)
    v = F.try_parse_json("value")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = lines.select(v.alias("v")).filter(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    inner = get("tool_input", "variant")
    input_ = F.when(inner.isNull() | F.is_variant_null(inner), F.parse_json(F.lit("{}"))).otherwise(inner)
    return rows.select(get("session_id", "string").alias("session_id"), F.try_to_timestamp(get("ts", "string")).alias("ts"), get("tool_name", "string").alias("tool_name"), F.to_json(input_).alias("tool_input_json"), get("tool_response", "variant").alias("tool_response"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines (``line_no`` from 0, file, type, uuid, timestamp, message) of one or many files.

    A file is read whole and split on its own line ends only, so that numbers are stable; blank, malformed and
    non-object lines are skipped but counted. A path that does not exist has no rows.
    """
    empty = T.StructType.fromDDL("file STRING, line_no INT, type STRING, uuid STRING, timestamp STRING, message STRING")
    if not path or not _exists(spark, path):
        return spark.createDataFrame([], empty)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    rows = whole.withColumn("v", F.try_parse_json("line")).filter(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))
    return rows.select("file", "line_no", text("type").alias("type"), text("uuid").alias("uuid"), text("timestamp").alias("timestamp"), F.to_json(F.try_variant_get("v", "$.message", "variant")).alias("message"))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file; a missing file, broken JSON or anything but an array has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    value = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    is_list = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    return value.filter(is_list).select(F.explode(F.from_json(F.to_json("v"), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object file of strings; anything else has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    value = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    is_map = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return value.filter(is_map).select(F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("key", "value"))


def document(spark: SparkSession, path: str) -> DataFrame:
    """(text) of one document; "" if it is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([("",)], "text string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text")).limit(1)


def by_id(df: DataFrame, id_: str) -> DataFrame:
    """The row of one id; none if it does not exist."""
    return df.filter(F.col("id") == id_)


def build_query(folder: str, commits: int = 3, timeout_s: int = 5) -> str:
    """The project's name and its last commit subjects; only the name if there is no history."""
    name = os.path.basename(os.path.abspath(folder))
    try:
        log = subprocess.run(["git", "-C", folder, "log", f"-{commits}", "--pretty=%s"], capture_output=True, text=True, timeout=timeout_s, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        log = ""
    return f"{name} {log}".strip()
