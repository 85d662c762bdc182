"""Statistical detectors over the calls of sessions, and digests of sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, json_object_field, publishes
from ..schemas import DIGEST_CUT, EXAMPLE_CUT, EXAMPLES_PER_TOOL, LOOKBACK, MIN_EDITS, MIN_READ_RATIO, MIN_SHELL_CALLS
from .ordering import with_previous

SALTS = 16
Detector = Callable[[DataFrame], DataFrame]

#: What the detectors propose.
READ_FIRST = {"id": "read-before-edit-pattern", "trigger": "即将编辑一个本次会话尚未 Read 过的文件", "action": "先用 Read 工具读取该文件当前内容，再执行 Edit/Write", "domain": "workflow"}
NO_COMMIT = {"id": "no-auto-commit-pattern", "trigger": "本次会话执行了多次 Bash 调用但从未 commit/push", "action": "不主动执行 git commit/push，等待用户明确授权", "domain": "git"}
READ_EVIDENCE, COMMIT_EVIDENCE = "%d/%d 次编辑前有先 Read", "本次会话 %d 次 Bash 调用中无 commit/push"
DIGEST_HEAD, DIGEST_TOOL, DIGEST_EXAMPLE, DIGEST_MORE = "本次会话共 %d 条观测记录，按工具类型汇总：", "- %s: 共 %d 次", "  例: ", "...(截断)"


def edits_after_reads(observations: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(session_id, edits, read_first): edits of a file, and those with a read of it among the calls just before.

    Order is by time, then id, missing times first. A window of ``lookback`` rows is all that is looked at.
    """
    calls = observations.filter(F.col("session_id").isNotNull()).select("session_id", F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")).alias("ts"), "id", "tool_name", json_object_field("tool_input_json", "file_path").alias("path"))
    seen = with_previous(calls, "session_id", ["ts", "id"], calls.columns, lookback, "calls")
    read = F.exists("previous", lambda x: F.coalesce((x["tool_name"] == "Read") & (x["path"] == F.col("path")), F.lit(False)))
    edits = seen.withColumn("read_first", read).filter(F.col("tool_name").isin("Edit", "Write") & (F.col("path") != ""))
    return edits.groupBy("session_id").agg(F.count("*").alias("edits"), F.count_if("read_first").alias("read_first"))


def detect_read_first(observations: DataFrame) -> DataFrame:
    """A candidate for each session that usually reads a file before it edits it."""
    found = edits_after_reads(observations).filter((F.col("edits") >= MIN_EDITS) & (F.col("read_first") / F.col("edits") >= MIN_READ_RATIO))
    return _candidates(found, READ_FIRST, F.format_string(READ_EVIDENCE, "read_first", "edits"))


def shell_without_commit(observations: DataFrame, min_calls: int = MIN_SHELL_CALLS) -> DataFrame:
    """(session_id, shell_calls) of sessions with enough shell calls, none of which commits or pushes."""
    shell = observations.filter((F.col("tool_name") == "Bash") & F.col("session_id").isNotNull())
    commits = F.count_if(publishes(json_object_field("tool_input_json", "command")))
    return shell.groupBy("session_id").agg(F.count("*").alias("shell_calls"), commits.alias("c")).filter((F.col("shell_calls") >= min_calls) & (F.col("c") == 0)).drop("c")


def detect_no_commit(observations: DataFrame) -> DataFrame:
    """A candidate for each session that never commits on its own."""
    return _candidates(shell_without_commit(observations), NO_COMMIT, F.format_string(COMMIT_EVIDENCE, "shell_calls"))


def _candidates(found: DataFrame, fixed: dict[str, str], evidence: F.Column) -> DataFrame:
    return found.select("session_id", *[F.lit(v).alias(k) for k, v in fixed.items()], evidence.alias("evidence"))


DETECTORS: list[Detector] = [detect_read_first, detect_no_commit]


def detect_patterns(observations: DataFrame, detectors: list[Detector] | None = None, compat: bool = False) -> DataFrame:
    """The candidates of all detectors, in the detectors' order (``detector``).

    Input that is no JSON object has no path and no command. With ``compat`` a session that has such input
    gives no candidates at all, as where one malformed row makes a detector fail.
    """
    rows = observations
    if compat:
        odd = F.count_if(F.coalesce(~F.schema_of_variant(F.try_parse_json("tool_input_json")).startswith("OBJECT"), F.lit(False)))
        broken = rows.groupBy("session_id").agg(odd.alias("odd")).filter(F.col("odd") > 0)
        rows = rows.join(broken.select("session_id"), "session_id", "left_anti")
    parts = [d(rows).withColumn("detector", F.lit(i)) for i, d in enumerate(detectors or DETECTORS)]
    return reduce(DataFrame.unionByName, parts)


def tool_digest(observations: DataFrame, keys: list[str], examples: int = EXAMPLES_PER_TOOL) -> DataFrame:
    """(keys, tool_name, calls, first_id, examples): count and first inputs of each tool; no tool is 'unknown'.

    The first rows are found in two steps, among ``SALTS`` parts of each group and then among their winners,
    so no task sorts a whole group.
    """
    group = [*keys, "tool_name"]
    rows = observations.select(*keys, F.coalesce("tool_name", F.lit("unknown")).alias("tool_name"), "id", cut(F.coalesce("tool_input_json", F.lit("{}")), EXAMPLE_CUT, "...").alias("example"))
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for salt in (["salt"], []):
        w = Window.partitionBy(*group, *salt).orderBy("id")
        part = part.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= examples)
    first = part.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "example"))), lambda x: x["example"]).alias("examples"))
    counts = rows.groupBy(*group).agg(F.count("*").alias("calls"), F.min("id").alias("first_id"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in group]
    return counts.alias("c").join(first.alias("f"), reduce(lambda a, b: a & b, same)).select(*[F.col(f"c.{k}") for k in group], "calls", "first_id", "examples")


def session_digest(observations: DataFrame) -> DataFrame:
    """(session_id, calls, digest): one text a session; tools in order of first appearance."""
    tools = tool_digest(observations.filter(F.col("session_id").isNotNull()), ["session_id"])
    lines = F.concat(F.array(F.format_string(DIGEST_TOOL, "tool_name", "calls")), F.transform("examples", lambda e: F.concat(F.lit(DIGEST_EXAMPLE), e)))
    text = tools.select("session_id", "calls", "first_id", F.array_join(lines, "\n").alias("text"))
    grouped = text.groupBy("session_id").agg(F.sum("calls").alias("calls"), F.array_sort(F.collect_list(F.struct("first_id", "text"))).alias("x"))
    whole = F.concat(F.format_string(DIGEST_HEAD, "calls"), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["text"]), "\n"))
    return grouped.select("session_id", "calls", cut(whole, DIGEST_CUT, DIGEST_MORE).alias("digest"))
