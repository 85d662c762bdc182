"""Queries of the engine's own operators on whole tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import redact, text
from ..operators import confidence, detect, events, matching, merge, progress, recall, render, turns
from ..runtime import big_join, table

#: The question of the recall query and the day on which merges are dated.
QUESTION = "set the cache schema before the worker can merge a stale snapshot"
TODAY = dt.date(2031, 6, 1)
NOW = "2031-06-01 00:00:00"


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observations")


def _entities(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).withColumn("id", F.col("row_id").cast("string"))


def redact_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("id", redact.redact_text("tool_input_json").alias("tool_input"), redact.redact_text("tool_response_summary").alias("response"))


def redact_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("id", redact.redact_json("tool_input_json").alias("tool_input"))


def redaction_stats(spark: SparkSession, folder: str) -> DataFrame:
    changed = lambda c: F.col(c) != redact.redact_text(c)
    return _calls(spark, folder).groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(changed("tool_input_json")).alias("inputs"), F.count_if(changed("tool_response_summary")).alias("responses"))


def sensitive_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("id", redact.first_path("tool_input_json").alias("path")).filter(redact.is_sensitive_path("path"))


def masked_calls(spark: SparkSession, folder: str) -> DataFrame:
    return redact.mask_records(_calls(spark, folder), redact.sensitive_path("tool_input_json", "tool_response_summary"), ["tool_input_json", "tool_response_summary"]).select("id", "tool_name", "file", "tool_input_json", "tool_response_summary")


def response_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("id", text.cut("tool_response_summary", 200, "...").alias("brief"))


def call_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Each call with the first one of the same identity."""
    keyed = _calls(spark, folder).select("id", text.call_key("tool_name", "tool_input_json").alias("call_key"))
    first = keyed.groupBy("call_key").agg(F.min("id").alias("first_id"))
    return big_join(keyed, first, "call_key").select("id", "first_id")


def dedup_calls(spark: SparkSession, folder: str) -> DataFrame:
    return events.dedup_windowed(_calls(spark, folder).withColumn("call_key", text.call_key("tool_name", "tool_input_json")), ["call_key"]).select("id")


def retained_calls(spark: SparkSession, folder: str) -> DataFrame:
    return events.retained(_calls(spark, folder), F.lit(NOW).cast("timestamp")).select("id", "session_id")


def incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    """New calls of all sessions past the cursor 100."""
    return events.new_observations(_calls(spark, folder), after_id=100).select("id", "session_id", "tool_name")


def range_scan(spark: SparkSession, folder: str) -> DataFrame:
    start, end = (F.lit(d).cast("timestamp") for d in ("2031-03-12", "2031-04-01"))
    return events.observations_between(_calls(spark, folder), start, end).select("id", "session_id", "tool_name")


def transcript_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turns(_first_lines(table(spark, folder, "transcript"))).select("session_id", "turn_no", "uuid", "user", "assistant")


def _first_lines(lines: DataFrame) -> DataFrame:
    """A line written twice counts at its first place, or time where it has none; lines without uuid all stay."""
    time = text.parse_time_us("timestamp")
    place = F.struct(F.col("line_no").isNull().alias("no_line"), "line_no", time.isNull().alias("no_time"), time.alias("time_us"), "timestamp", "type", "message")
    named = lines.filter(F.col("uuid") != "").groupBy("session_id", "uuid").agg(F.min_by(F.struct(*[c for c in lines.columns if c not in ("session_id", "uuid")]), place).alias("x")).select("session_id", "uuid", "x.*")
    return named.select(*lines.columns).unionByName(lines.filter(F.coalesce("uuid", F.lit("")) == ""))


def turns_after_cursor(spark: SparkSession, folder: str) -> DataFrame:
    found = turns.turns(_first_lines(table(spark, folder, "transcript")))
    return turns.turns_after(found, table(spark, folder, "session_progress")).select("session_id", "turn_no", "uuid")


def turn_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return turns.with_feedback(turns.turns(_first_lines(table(spark, folder, "transcript")))).select("session_id", "turn_no", "uuid", "next_user")


def episode_steps(spark: SparkSession, folder: str) -> DataFrame:
    return turns.episodes(turns.turns(_first_lines(table(spark, folder, "transcript"))), _calls(spark, folder)).select("session_id", "turn_no", "uuid", "calls")


def read_before_edit(spark: SparkSession, folder: str) -> DataFrame:
    return detect.edits_after_reads(_calls(spark, folder))


def no_commit_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return detect.shell_without_commit(_calls(spark, folder))


def detected_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return detect.detect_patterns(_calls(spark, folder))


def tool_digests(spark: SparkSession, folder: str) -> DataFrame:
    return detect.tool_digest(_calls(spark, folder), ["session_id"]).select("session_id", "tool_name", "calls", "first_id", F.array_join("examples", "\n").alias("examples"))


def session_digests(spark: SparkSession, folder: str) -> DataFrame:
    return detect.session_digest(_calls(spark, folder))


def confidence_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of each tool after all its calls; a call that ended with an exit code other than 0 is a miss."""
    hit = ~F.coalesce(F.col("tool_response_summary").rlike(r"^exit [1-9]"), F.lit(False))
    return confidence.fold_confidence(_calls(spark, folder).select("session_id", "id", hit.alias("hit")), ["session_id"], ["id"])


def promoted_rules(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.promoted(table(spark, folder, "instincts"), tie=["row_id"]).select("row_id", "id", "trigger", "confidence", "domain")


def rules_document(spark: SparkSession, folder: str) -> DataFrame:
    return render.rules_text(confidence.promoted(table(spark, folder, "instincts"), tie=["row_id"]))


def _matchable(spark: SparkSession, folder: str, gate: bool) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "instincts")
    columns = [F.col("trigger").alias("text"), F.col("domain").alias("gate")] if gate else [F.col("trigger").alias("text")]
    ask = rows.filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), *columns)
    return ask, rows.select(F.col("row_id").alias("match_id"), F.col("row_id").alias("ord"), *columns)


def similar_in_domain(spark: SparkSession, folder: str) -> DataFrame:
    return matching.best_text_matches(*_matchable(spark, folder, True), gated=True, others_only=True).withColumn("score", F.round("score", 9))


def similar_any(spark: SparkSession, folder: str) -> DataFrame:
    return matching.best_text_matches(*_matchable(spark, folder, False), others_only=True).withColumn("score", F.round("score", 9))


def similar_by_keyword(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories")
    ask = rows.filter(F.col("row_id") % 100 == 0).select(F.col("row_id").alias("query_id"), F.col("description").alias("text"), "keywords")
    candidates = rows.select(F.col("row_id").alias("match_id"), F.col("row_id").alias("ord"), F.col("description").alias("text"), "keywords")
    return matching.best_keyword_matches(ask, candidates, others_only=True).withColumn("score", F.round("score", 9))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id"), rows


def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    return recall.knn(*_vectors(spark, folder), k=5, metric="l2")


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return recall.knn(*_vectors(spark, folder), k=5, metric="cosine")


def knn_live_only(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours among the vectors of parts that exist: dead vectors go before the nearest are taken."""
    ask, rows = _vectors(spark, folder)
    live = table(spark, folder, "part").filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("id"))
    return recall.knn(ask, recall.live_only(rows, live, "id"), k=5, metric="l2")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memories").select(F.col("row_id").alias("id"), text.cacheable_text("body", "keywords").alias("text"))


def tfidf_recall(spark: SparkSession, folder: str) -> DataFrame:
    return recall.recall_tfidf(_texts(spark, folder), QUESTION, k=10)


def embed_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text changed since the batch before: the cache holds the texts of batch 0 by id."""
    rows = table(spark, folder, "memories").filter(F.col("id").isNotNull()).select("row_id", F.col("id").alias("memory_id"), "batch_no", text.cacheable_text("body", "keywords").alias("text"))
    cache = rows.filter(F.col("batch_no") == 0).groupBy("memory_id").agg(F.min_by("text", "row_id").alias("t")).select("memory_id", F.lit("m").alias("model"), text.content_hash("t").alias("content_hash"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    return recall.cache_misses(rows.select("row_id", "memory_id", "text"), cache, "m").select("row_id", "memory_id", "content_hash")


def slug_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memories").select("row_id", text.kebab_id("id", F.coalesce("description", F.lit(""))).alias("safe_id"), text.slug(F.coalesce("description", F.lit(""))).alias("slug"))


def package_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("session_id", F.explode(text.named_managers("tool_input_json")).alias("manager")).groupBy("session_id", "manager").agg(F.count("*").alias("calls"))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    return progress.claim_decisions(table(spark, folder, "session_progress"), F.lit(NOW).cast("timestamp")).select("session_id", "decision")


def orphan_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return progress.orphans(table(spark, folder, "session_progress"), F.lit(NOW).cast("timestamp")).select("session_id", "last_processed_uuid")


def session_cursors(spark: SparkSession, folder: str) -> DataFrame:
    return progress.next_cursors(_calls(spark, folder))


def summary_due(spark: SparkSession, folder: str) -> DataFrame:
    return progress.due_for_summary(turns.turns(_first_lines(table(spark, folder, "transcript"))), threshold=5)


def recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "session_progress").filter(F.col("updated_at").isNotNull()).select("session_id", F.col("updated_at").alias("last_exit_ts"), F.coalesce("transcript_path", F.lit("")).alias("summary_excerpt"))
    return progress.recent_sessions(rows.limit(0), rows)


def instinct_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Batches 1 and later merged one by one into the instincts of batch 0."""
    rows = table(spark, folder, "instincts")
    store = rows.filter(F.col("batch_no") == 0).groupBy("id").agg(F.max_by(F.struct(*[c for c in S.INSTINCT.fieldNames() if c != "id"]), "row_id").alias("x")).select("id", "x.*")
    new = rows.filter(F.col("batch_no") > 0).select(F.col("row_id").alias("seq"), "id", "trigger", F.lit(None).cast("string").alias("action"), "domain", F.lit(None).cast("string").alias("evidence"))
    return merge.merge_instincts(store, new, TODAY).select("id", "trigger", "domain", "confidence", "hit_count")


def fact_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Batches 1 and later merged one by one into the memories of batch 0."""
    rows = table(spark, folder, "memories")
    store = rows.filter((F.col("batch_no") == 0) & F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*[c for c in S.MEMORY.fieldNames() if c != "id"]), "row_id").alias("x")).select("id", "x.*")
    new = rows.filter(F.col("batch_no") > 0).select(F.col("row_id").alias("seq"), F.col("id").alias("name"), "description", "body", "type", "keywords")
    return merge.merge_facts(store, new, TODAY).select("id", "type", "description", "created")


def procedure_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The triggers of instincts as tasks of procedures: batches 1 and later merged one by one into those of batch 0."""
    rows = table(spark, folder, "instincts").filter(F.col("id").isNotNull())
    status = F.when(F.coalesce("deprecated", F.lit(False)), "deprecated").when(F.col("confidence") >= S.PROMOTE_AT, "promoted").otherwise("candidate")
    fields = {"task_type": F.col("trigger"), "hit_count": F.col("hit_count"), "confidence": F.col("confidence"), "status": status, "skill_asked": F.lit(False), "first_seen": F.col("last_seen"), "last_seen": F.col("last_seen"), "evidence_sessions": F.array().cast("array<string>"), "body": F.col("body")}
    store = rows.filter(F.col("batch_no") == 0).groupBy("id").agg(F.max_by(F.struct(*[c.alias(n) for n, c in fields.items()]), "row_id").alias("x")).select("id", "x.*")
    new = rows.filter(F.col("batch_no") > 0).select(F.col("row_id").alias("seq"), F.col("domain").alias("session_id"), "id", F.col("trigger").alias("task_type"), F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("note"), (F.coalesce("hit_count", F.lit(0)) >= 2).alias("is_successful"))
    merged = merge.merge_procedures(store, new, TODAY)
    return merged.select("id", "task_type", "hit_count", F.round("confidence", 9).alias("confidence"), "status", "skill_asked", F.array_join("evidence_sessions", ",").alias("sessions"), "promoted_now")


QUERIES = {
    f.__name__: f
    for f in (redact_calls, redact_inputs, redaction_stats, sensitive_calls, masked_calls, response_cuts, call_keys, dedup_calls, retained_calls, incremental_scan, range_scan, transcript_turns, turns_after_cursor, turn_feedback, episode_steps, read_before_edit, no_commit_sessions, detected_patterns, tool_digests, session_digests, confidence_fold, promoted_rules, rules_document, similar_in_domain, similar_any, similar_by_keyword, knn_l2, knn_cosine, knn_live_only, tfidf_recall, embed_cache_misses, slug_ids, package_facts, claims, orphan_sessions, session_cursors, summary_due, recent_sessions, instinct_merge, fact_merge, procedure_merge)
}
