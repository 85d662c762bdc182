"""The seven pipelines, each from tables to tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.redact import mask_records, sensitive_path
from ..functions.text import call_key
from ..operators import confidence, detect, events, merge, progress, recall, render, turns
from ..providers import Analyser, RuleAnalyser
from ..runtime import materialise

Factory = Callable[[], Analyser]


def observe(arrived: DataFrame, store: DataFrame, now: dt.datetime, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, state) after new events: identical calls within the window once, secrets masked, old rows gone.

    The identity of a call is taken before it is masked; only its hash is used. ``state`` is that of the batch
    before, so that splitting events into batches changes nothing.
    """
    keyed = materialise(arrived.withColumn("call_key", call_key("tool_name", "tool_input_json")), "arrived")
    once = materialise(events.dedup_windowed(keyed, ["call_key"], state=state), "once")
    after = events.dedup_state(once, ["call_key"], before=state)
    masked = mask_records(once.drop("call_key"), sensitive_path("tool_input_json", "tool_response_summary"), ["tool_input_json", "tool_response_summary"]).drop("file")
    return events.appended(store, masked.select(*store.columns), now), after


def analysed(digests: DataFrame, make: Factory = RuleAnalyser) -> tuple[DataFrame, DataFrame]:
    """(instincts, facts) an analyser finds in session digests (session_id, digest); a failing call finds nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            out = []
            for text in frame["digest"]:
                try:
                    found = provider.analyze(text or "")
                    out.append(json.dumps({k: found.get(k) or [] for k in ("instincts", "project_facts")}, ensure_ascii=False))
                except Exception:  # noqa: BLE001 - analysis is optional
                    out.append("{}")
            yield pd.DataFrame({"session_id": frame["session_id"], "found": out})

    found = digests.select("session_id", "digest").mapInPandas(run, "session_id string, found string")
    kinds = {"instincts": "id string, trigger string, action string, domain string, evidence string", "project_facts": "name string, description string, body string, type string, keywords array<string>"}
    both = found.withColumn("f", F.from_json("found", ", ".join(f"{k} array<struct<{v}>>" for k, v in kinds.items())))
    return tuple(both.select("session_id", F.posexplode(f"f.{k}").alias("n", "x")).select("session_id", "n", "x.*") for k in kinds)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Candidates with ``seq`` in a fixed order; candidates are few, as detectors and analysers give some a session."""
    from ..operators.ordering import globally_ordered

    return globally_ordered(df, order, [c for c in df.columns], "candidates").withColumnRenamed("place", "seq")


def extract(observations: DataFrame, instincts: DataFrame, memories: DataFrame, today: dt.date, make: Factory = RuleAnalyser) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(instincts, memories, rules text, cursors) after a batch of new observations; statistical candidates come first."""
    found = detect.detect_patterns(observations).select("session_id", "detector", F.lit(0).alias("n"), "id", "trigger", "action", "domain", "evidence")
    semantic, facts = analysed(detect.session_digest(observations), make)
    more = semantic.select("session_id", F.lit(len(detect.DETECTORS)).alias("detector"), "n", "id", "trigger", "action", "domain", "evidence")
    candidates = _numbered(found.unionByName(more), ["session_id", "detector", "n"])
    fact_rows = _numbered(facts, ["session_id", "n"])
    merged = merge.merge_instincts(instincts, candidates.select(*S.INSTINCT_CANDIDATE.fieldNames()), today)
    known = merge.merge_facts(memories, fact_rows.select(*S.FACT_CANDIDATE.fieldNames()), today)
    return merged, known, render.rules_text(confidence.promoted(merged)), progress.next_cursors(observations)


def recall_context(instincts: DataFrame, memories: DataFrame, summary: str, query: str, provider: object, k: int = S.RECALL_K) -> DataFrame:
    """The context of a session start: summary, promoted habits, nearest memories."""
    return render.context_json(summary, confidence.promoted(instincts), recall.recall_top_k(memories, query, provider, k))


def summarise(new_turns: DataFrame, summary: str, forced: DataFrame | None = None, make: Factory = RuleAnalyser, threshold: int = S.SUMMARIZE_AT_TURNS) -> tuple[DataFrame, DataFrame]:
    """(summaries, cursors) of the sessions that are due; a session whose summary fails keeps its cursor (at least once)."""
    due = progress.due_for_summary(new_turns, forced, threshold)
    texts = turns.turns_text(new_turns.join(due.select("session_id"), "session_id", "left_semi"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            rows = []
            for session, text in zip(frame["session_id"], frame["text"], strict=True):
                try:
                    rows.append((session, provider.summarize(summary, text)))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["session_id", "summary"])

    done = texts.mapInPandas(run, "session_id string, summary string")
    last = new_turns.groupBy("session_id").agg(F.max_by("uuid", "turn_no").alias("last_processed_uuid"))
    return done, last.join(done.select("session_id"), "session_id", "left_semi")


def mine_procedures(new_turns: DataFrame, observations: DataFrame, procedures: DataFrame, today: dt.date, make: Factory = RuleAnalyser) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(procedures, messages, cursors) after the episodes of new turns; each episode is offered once, the last turn waits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    found = provider.mine_procedure(r.steps, r.assistant or "", r.next_user or "")
                except Exception:  # noqa: BLE001 - one failed episode must not stop the others
                    continue
                if found:
                    rows.append((r.session_id, r.turn_no, found.get("id"), found.get("task_type"), [str(s) for s in found.get("steps") or []], found.get("note"), bool(found.get("is_successful", True))))
            yield pd.DataFrame(rows, columns=["session_id", "turn_no", "id", "task_type", "steps", "note", "is_successful"])

    found = turns.episodes(new_turns, observations).mapInPandas(run, "session_id string, turn_no int, id string, task_type string, steps array<string>, note string, is_successful boolean")
    candidates = _numbered(found, ["session_id", "turn_no"])
    merged = merge.merge_procedures(procedures, candidates.select(*S.PROCEDURE_CANDIDATE.fieldNames()), today)
    return merged.drop("promoted_now"), render.promotion_messages(merged), turns.release_cursors(new_turns)


def notify(procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompt, procedures with the flag set): shown first, flagged after, so a crash repeats the prompt."""
    pending = render.pending_procedures(procedures).select("id").withColumn("asked", F.lit(True))
    flagged = procedures.join(pending, "id", "left").withColumn("skill_asked", F.coalesce("asked", "skill_asked")).drop("asked")
    return render.pending_prompts(procedures), flagged.select(*procedures.columns)


def record_session(stored: DataFrame, session_id: str | None, now: dt.datetime, summary: str) -> tuple[DataFrame, DataFrame]:
    """(recent sessions, their text) after the end of a session; no id changes nothing."""
    ended = stored.sparkSession.createDataFrame([(session_id, now, summary)] if session_id else [], S.RECENT_SESSION)
    rows = progress.recent_sessions(stored, ended)
    return rows, render.recent_text(rows)
