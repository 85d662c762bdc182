"""Text and JSON made of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_label, habit_line

#: Headings and prompts.
RULES_HEAD = "# 自动演化规则（自动生成，请勿手工编辑）"
PENDING_PROMPT = "[procedure-pending]\n检测到流程「%s」已稳定复现 %s 次（memory/procedures/%s.md），\n请先询问用户：1) 这个流程实际上是否正确/有效；2) 是否要转换为 Skill。\n若用户反馈流程不正确，请把该 procedure 文件的 status 改为 deprecated（不要转成 Skill）；\n用户确认流程正确且要转换，再执行转换；不要自作主张直接转。"
PROMOTED_MESSAGE = "🎯 检测到可复用流程「%s」已出现 %s 次，已保存到 memory/procedures/%s.md，可考虑转成 Skill。"


def joined(df: DataFrame, line: Column, order: list[Column], separator: str = "\n", name: str = "text") -> DataFrame:
    """One row: the lines of a small, already limited table in order, as one text ("" if there are none)."""
    rows = df.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).alias("x"))
    return rows.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), separator), F.lit("")).alias(name))


def rules_text(promoted: DataFrame) -> DataFrame:
    """The rules document of promoted instincts (at most the rules limit)."""
    name = F.coalesce("trigger", "id")
    line = F.format_string("- **%s** (confidence: %.2f, domain: %s)", name, "confidence", F.coalesce("domain", F.lit("")))
    text = joined(promoted, line, [-F.col("confidence"), F.concat("id", F.lit(".md"))])
    return text.select(F.concat(F.lit(RULES_HEAD + "\n\n"), F.col("text"), F.lit("\n")).alias("text"))


def memory_lines(memories: DataFrame) -> DataFrame:
    """(rank, line) of recalled memories."""
    shown = F.when(F.col("description") != "", F.col("description")).otherwise(F.coalesce("body", F.lit("")))
    return memories.select("rank", F.concat(fact_label("type"), F.lit(" "), F.trim(shown)).alias("line"))


def habit_lines(instincts: DataFrame) -> DataFrame:
    return instincts.select((-F.col("confidence")).alias("rank"), "id", habit_line("domain", "trigger").alias("line"))


def context_json(summary: str, instincts: DataFrame, memories: DataFrame) -> DataFrame:
    """(context): one JSON object with the sections that are not empty and a message naming them; no row if all are."""
    habits, facts = joined(habit_lines(instincts), F.col("line"), [F.col("rank"), F.col("id")], name="habits"), joined(memory_lines(memories), F.col("line"), [F.col("rank")], name="facts")
    recap = F.lit(f"[project-recap]\n{summary.strip()}" if summary.strip() else None).cast("string")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    both = habits.withColumn("facts", F.lit(None).cast("string")).unionByName(facts.withColumn("habits", F.lit(None).cast("string"))).agg(F.coalesce(F.max("habits"), F.lit("")).alias("habits"), F.coalesce(F.max("facts"), F.lit("")).alias("facts"))
    sections = F.filter(F.array(recap, given("habits"), given("facts")), lambda x: x.isNotNull())
    title = F.array_join(F.filter(F.array(F.when(recap.isNotNull(), F.lit("[project-recap]")), F.when(F.col("habits") != "", F.concat(F.lit("[habit] "), F.size(F.split("habits", "\n")))), F.when(F.col("facts") != "", F.concat(F.lit("[memory] "), F.size(F.split("facts", "\n"))))), lambda x: x.isNotNull()), "\n")
    made = both.select(sections.alias("s"), title.alias("systemMessage")).filter(F.size("s") > 0)
    return made.select(F.to_json(F.struct("systemMessage", F.array_join("s", "\n").alias("additionalContext"))).alias("context"))


def pending_procedures(procedures: DataFrame) -> DataFrame:
    """Promoted procedures nobody was asked about."""
    return procedures.filter((F.col("status") == "promoted") & ~F.coalesce("skill_asked", F.lit(False)))


def pending_prompts(procedures: DataFrame) -> DataFrame:
    """(text): one prompt for all pending procedures."""
    line = F.format_string(PENDING_PROMPT, F.coalesce("task_type", F.lit("")), F.coalesce(F.col("hit_count").cast("string"), F.lit("")), "id")
    return joined(pending_procedures(procedures), line, [F.concat("id", F.lit(".md"))], "\n\n").filter(F.col("text") != "")


def mark_asked(procedures: DataFrame, ids: list[str]) -> DataFrame:
    """The flag set for the given ids; ids that do not exist change nothing."""
    return procedures.withColumn("skill_asked", F.when(F.col("id").isin(ids), F.lit(True)).otherwise(F.col("skill_asked")))


def promotion_messages(procedures: DataFrame) -> DataFrame:
    """(id, message) of the procedures promoted in this run."""
    return procedures.filter("promoted_now").select("id", F.format_string(PROMOTED_MESSAGE, "task_type", F.col("hit_count").cast("string"), "id").alias("message"))


def recent_text(sessions: DataFrame) -> DataFrame:
    """(text): recent sessions, newest first."""
    line = F.concat(F.lit("## "), F.coalesce(F.date_format("last_exit_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), F.lit(" — "), F.col("session_id"), F.lit("\n\n"), F.col("summary_excerpt"), F.lit("\n"))
    return joined(sessions, line, [-F.unix_micros("last_exit_ts"), F.col("session_id")]).select(F.concat(F.lit("# Recent sessions\n\n"), F.col("text")).alias("text"))


def merged_config(template: str, target: str | None, prefix: str = "", marker: str = "${PROJECT_DIR}/") -> str:
    """Hook groups of a template added to a target configuration, each event once for equal groups; idempotent.

    With ``prefix`` every string of the template has the marker followed by that folder. An administrative
    helper on two small documents, so plain Python.
    """

    def moved(node: object) -> object:
        if isinstance(node, str):
            return node.replace(marker, f"{marker}{prefix}/")
        if isinstance(node, list):
            return [moved(x) for x in node]
        return {k: moved(v) for k, v in node.items()} if isinstance(node, dict) else node

    hooks = json.loads(template).get("hooks", {})
    out = json.loads(target) if target else {}
    mine = out.setdefault("hooks", {})
    for event, groups in (moved(hooks) if prefix else hooks).items():
        have = mine.setdefault(event, [])
        have += [g for i, g in enumerate(groups) if g not in have and g not in groups[:i]]
    return json.dumps(out, ensure_ascii=False, indent=2)
