"""Transcript lines as turns, cursors over them, and turns with the calls made in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, is_typed_prompt, parse_time_us, spoken_text
from ..runtime import big_join, materialise
from ..schemas import MIN_EPISODE_CALLS, STEP_CUT, TURN_CUT
from .ordering import carried_forward, running_count

#: Fixed value: what ends a text that was cut.
CUT_MARK = "...(截断)"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines in a form that can be ordered: role facts and text; only prompts and assistant lines remain."""
    m = lines.withColumn("m", F.try_parse_json("message")).filter(F.col("session_id").isNotNull())
    prompt = is_typed_prompt("type", "m") & (F.coalesce("uuid", F.lit("")) != "")
    rows = m.withColumn("is_prompt", prompt).filter(F.col("is_prompt") | (F.col("type") == "assistant"))
    text = F.when(F.col("is_prompt"), F.try_variant_get("m", "$.content", "string")).otherwise(spoken_text("m"))
    return rows.select("session_id", "line_no", "uuid", F.timestamp_micros(parse_time_us("timestamp")).alias("ts"), parse_time_us("timestamp").alias("time_us"), "is_prompt", text.alias("text"))


def turns(lines: DataFrame, order: str = "line_no", limit: int = TURN_CUT) -> DataFrame:
    """(session_id, turn_no, uuid, user, assistant, ts): a prompt with all assistant text up to the next one.

    Rows before the first prompt are dropped. A running count of prompts numbers the turns (a prefix sum over
    chunks, whatever the size of a session), and texts are joined per turn. Lines without an order come last and follow
    their time, unreadable times last; equal ones follow the uuid.
    """
    rows = parsed_lines(lines).withColumns({"no_order": F.col(order).isNull(), "no_time": F.col("time_us").isNull()})
    keys = ["no_order", order, "no_time", "time_us", "uuid"]
    numbered = running_count(rows, "session_id", keys, rows.columns, F.col("is_prompt"), "lines").withColumn("turn_no", F.col("running").cast("int")).filter(F.col("turn_no") > 0)
    said = F.array_sort(F.collect_list(F.when(~F.col("is_prompt") & (F.col("text") != ""), F.struct(*keys, "text"))))
    grouped = numbered.groupBy("session_id", "turn_no").agg(F.max(F.when(F.col("is_prompt"), F.struct("uuid", "text", "ts"))).alias("p"), said.alias("said"))
    answer = F.array_join(F.transform("said", lambda x: x["text"]), "\n")
    made = grouped.select("session_id", "turn_no", "p.uuid", cut("p.text", limit, CUT_MARK).alias("user"), cut(answer, limit, CUT_MARK).alias("assistant"), "p.ts")
    return materialise(made, "session_turns")  # what follows reads turns more than once


def turns_after(turns_: DataFrame, cursors: DataFrame) -> DataFrame:
    """Turns past each session's cursor (``last_processed_uuid``); a null or unknown cursor leaves all turns.

    The first turn with the cursor's uuid counts.
    """
    at = big_join(turns_, cursors.select("session_id", F.col("last_processed_uuid").alias("uuid")), ["session_id", "uuid"]).groupBy("session_id").agg(F.min("turn_no").alias("seen"))
    return big_join(turns_, at, "session_id", "left").filter(F.col("turn_no") > F.coalesce("seen", F.lit(0))).drop("seen")


def with_feedback(turns_: DataFrame) -> DataFrame:
    """Turns that have a successor, with the next prompt and its time; the last turn of a session is held back."""
    after = turns_.select("session_id", (F.col("turn_no") - 1).alias("turn_no"), F.col("user").alias("next_user"), F.col("ts").alias("next_ts"))
    return big_join(turns_, after, ["session_id", "turn_no"])


def release_cursors(turns_: DataFrame) -> DataFrame:
    """(session_id, last_processed_uuid): the last turn of each session that has a successor."""
    return with_feedback(turns_).groupBy("session_id").agg(F.max_by("uuid", "turn_no").alias("last_processed_uuid"))


def step_line(place: Column, tool: Column, input_json: Column) -> Column:
    return F.concat(place.cast("string"), F.lit(". "), F.coalesce(tool, F.lit("unknown")), F.lit(": "), cut(F.coalesce(input_json, F.lit("{}")), STEP_CUT, "..."))


def episodes(turns_: DataFrame, observations: DataFrame, min_calls: int = MIN_EPISODE_CALLS) -> DataFrame:
    """(session_id, turn_no, uuid, user, assistant, next_user, calls, steps) of turns with enough calls.

    Calls belong to the turn in [ts, next ts) of their session. Turns and calls are merged in one global order
    and every call takes the last turn before it, carried over chunks: no range join, no task per session. An unreadable start
    is open to the past; an unreadable end gives the turn no calls.
    """
    ahead = with_feedback(turns_)
    marks = ahead.filter(F.col("next_ts").isNotNull()).select("session_id", F.coalesce("ts", F.lit(0).cast("timestamp")).alias("ts"), F.lit(0).alias("is_call"), F.lit(0).cast("long").alias("id"), "turn_no", "next_ts", F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_input_json"))
    calls = observations.filter(F.col("session_id").isNotNull()).select("session_id", "ts", F.lit(1).alias("is_call"), "id", F.lit(None).cast("int").alias("turn_no"), F.lit(None).cast("timestamp").alias("next_ts"), "tool_name", "tool_input_json")
    merged = marks.unionByName(calls)
    owned = carried_forward(merged, "session_id", ["ts", "is_call", "turn_no", "id"], merged.columns, ["turn_no", "next_ts"], "marks").filter((F.col("is_call") == 1) & (F.col("ts") < F.col("next_ts")))
    in_turn = Window.partitionBy("session_id", "turn_no").orderBy("id")
    lines = owned.withColumn("place", F.row_number().over(in_turn)).select("session_id", "turn_no", "place", step_line(F.col("place"), F.col("tool_name"), F.col("tool_input_json")).alias("line"))
    steps = lines.groupBy("session_id", "turn_no").agg(F.count("*").alias("calls"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x")).filter(F.col("calls") >= min_calls)
    steps = steps.select("session_id", "turn_no", "calls", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("steps"))
    return big_join(ahead, steps, ["session_id", "turn_no"]).select("session_id", "turn_no", "uuid", "user", "assistant", "next_user", "calls", "steps")


def turns_text(turns_: DataFrame) -> DataFrame:
    """(session_id, turns, text): the turns of a session as one numbered text for a summary."""
    w = Window.partitionBy("session_id").orderBy("turn_no")
    block = F.concat(F.lit("### Turn "), F.col("n"), F.lit(" (uuid: "), F.coalesce("uuid", F.lit("")), F.lit(")\n[user]\n"), F.coalesce("user", F.lit("")), F.lit("\n[assistant]\n"), F.coalesce("assistant", F.lit("")))
    blocks = turns_.withColumn("n", F.row_number().over(w)).select("session_id", "n", block.alias("block"))
    return blocks.groupBy("session_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("text"))
