"""Session progress as a table: leases, cursors, orphans, thresholds and recent sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXCERPT_CUT, LEASE_STALE_S, RECENT_SESSIONS, SUMMARIZE_AT_TURNS


def _status() -> Column:
    return F.lower(F.trim(F.coalesce("status", F.lit("idle"))))


def lease_age_s(now: Column) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds("updated_at")


def claim_decisions(progress: DataFrame, now: Column, stale_s: int = LEASE_STALE_S) -> DataFrame:
    """Progress rows with ``decision``: take an idle session, steal a stale lease, refuse a fresh one. A lease without a time is stale."""
    age = lease_age_s(now)
    return progress.withColumn("decision", F.when(_status() != "processing", "take").when(F.coalesce(age, F.lit(stale_s)) >= stale_s, "steal").otherwise("refuse"))


def claim(progress: DataFrame, sessions: DataFrame, now: dt.datetime, stale_s: int = LEASE_STALE_S) -> tuple[DataFrame, DataFrame]:
    """(progress after, claims): claim every session of ``sessions`` (session_id[, transcript_path]).

    claims has (session_id, claimed, cursor). Sessions not seen before get a row; refused ones keep theirs.
    """
    path = F.col("transcript_path") if "transcript_path" in sessions.columns else F.lit(None).cast("string")
    wanted = sessions.select("session_id", path.alias("new_path")).dropDuplicates(["session_id"])
    decided = claim_decisions(progress, F.lit(now), stale_s).join(wanted.withColumn("wanted", F.lit(True)), "session_id", "full")
    gets = F.col("wanted").isNotNull() & (F.coalesce("decision", F.lit("take")) != "refuse")
    after = decided.select("session_id", F.coalesce("new_path", "transcript_path").alias("transcript_path"), "last_processed_uuid", F.when(gets, F.lit("processing")).otherwise(F.col("status")).alias("status"), F.when(gets, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))
    claims = decided.filter(F.col("wanted").isNotNull()).select("session_id", gets.alias("claimed"), F.when(gets, F.col("last_processed_uuid")).alias("cursor"))
    return after, claims


def release(progress: DataFrame, cursors: DataFrame, now: dt.datetime) -> DataFrame:
    """Progress with the sessions of ``cursors`` (session_id, last_processed_uuid) idle at their new cursor; a null cursor keeps the old one."""
    new = cursors.select("session_id", F.col("last_processed_uuid").alias("to"), F.lit(True).alias("released")).dropDuplicates(["session_id"])
    hit = F.coalesce("released", F.lit(False))
    return progress.join(new, "session_id", "left").select("session_id", "transcript_path", F.coalesce("to", "last_processed_uuid").alias("last_processed_uuid"), F.when(hit, F.lit("idle")).otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def orphans(progress: DataFrame, now: Column, me: str | None = None, stale_s: int = LEASE_STALE_S) -> DataFrame:
    """Leases of other sessions that nobody renewed."""
    found = progress.filter((_status() == "processing") & (lease_age_s(now) >= stale_s))
    return found if me is None else found.filter(F.col("session_id") != me)


def next_cursors(observations: DataFrame) -> DataFrame:
    """(session_id, last_processed_id) after a batch."""
    return observations.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("id").alias("last_processed_id"))


def due_for_summary(new_turns: DataFrame, forced: DataFrame | None = None, threshold: int = SUMMARIZE_AT_TURNS) -> DataFrame:
    """(session_id, new_turns) of sessions with enough new turns, or with any if they are in ``forced`` (session_id)."""
    counts = new_turns.groupBy("session_id").agg(F.count("*").alias("new_turns"))
    if forced is None:
        return counts.filter(F.col("new_turns") >= threshold)
    marked = counts.join(forced.select("session_id").distinct().withColumn("forced", F.lit(True)), "session_id", "left")
    return marked.filter((F.col("new_turns") >= threshold) | F.col("forced")).select("session_id", "new_turns")


def recent_sessions(stored: DataFrame, ended: DataFrame, keep: int = RECENT_SESSIONS) -> DataFrame:
    """The latest row of each session of both tables (``schemas.RECENT_SESSION``), newest first, at most ``keep``. Rows without a session are ignored."""
    rows = stored.unionByName(ended).filter(F.coalesce("session_id", F.lit("")) != "")
    latest = rows.groupBy("session_id").agg(F.max(F.struct(F.col("last_exit_ts"), F.left(F.coalesce("summary_excerpt", F.lit("")), F.lit(EXCERPT_CUT)).alias("summary_excerpt"))).alias("x"))
    return latest.select("session_id", "x.last_exit_ts", "x.summary_excerpt").orderBy(F.desc("last_exit_ts"), "session_id").limit(keep)
