"""Turns and episodes against a plain fold over the lines, with sessions without places and all notations of time."""

import datetime as dt
import json
import os
import re

import pyarrow.parquet as pq
import pytest

from support import DATA
from test_operators import LINE, T0, calls, line
from tracewell.operators import turns
from tracewell.queries import QUERIES


def test_sessions_without_places_follow_their_time(spark):
    said = [{"type": "text", "text": "answer"}]
    rows = [
        line("s", None, "assistant", "a2", "second answer", "2031-03-01T00:00:04Z"),
        line("s", None, "user", "u2", "second", "1929916803000"),  # 2031-02-27T00:00:03
        line("s", None, "user", "u1", "first", "2031-02-27T00:00:01+00:00"),
        line("s", None, "assistant", "a1", said, "2031-02-27 00:00:02"),
    ]
    got = turns.turns(spark.createDataFrame(rows, LINE)).orderBy("turn_no").collect()
    assert [(t["turn_no"], t["uuid"], t["user"], t["assistant"]) for t in got] == [(1, "u1", "first", "answer"), (2, "u2", "second", "second answer")]


def time_us(text):
    text = (text or "").strip()
    if re.fullmatch(r"\d{12,14}", text):
        return int(text) * 1000
    try:
        t = dt.datetime.fromisoformat(text)
    except ValueError:
        return None
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def folded():
    """session -> [(uuid of the prompt, its time, assistant texts)]"""
    place = lambda r: (r["line_no"] is None, r["line_no"] or 0, time_us(r["timestamp"]) is None, time_us(r["timestamp"]) or 0, r["uuid"] or "", r["timestamp"] or "")
    seen, out = set(), {}
    for r in sorted(pq.read_table(f"{DATA}/transcript.parquet").to_pylist(), key=place):
        s, u = r["session_id"], r["uuid"]
        if s is None or (u and (s, u) in seen):
            continue
        seen.add((s, u))
        try:
            content = json.loads(r["message"] or "")["content"]
        except (ValueError, TypeError, KeyError):
            content = None
        if r["type"] == "user" and u and isinstance(content, str):
            out.setdefault(s, []).append((u, time_us(r["timestamp"]), []))
        elif r["type"] == "assistant" and s in out:
            text = content if isinstance(content, str) else "\n".join(b.get("text") or "" for b in content or [] if b.get("type") == "text")
            if text:
                out[s][-1][2].append(text)
    return out


def test_epoch_milliseconds_bound_episodes(spark):
    ms = lambda s: str(int((T0 + dt.timedelta(seconds=s)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    rows = [line("s", i, "user", f"u{i}", f"p{i}", ms(100 * i)) for i in range(3)]
    observed = calls(spark, [("s", t, "Read", {"a": 1}) for t in (-5, 0, 50, 99, 100, 120, 150, 199, 200)])
    got = turns.episodes(turns.turns(spark.createDataFrame(rows, LINE)), observed).collect()
    assert {(e["uuid"], e["calls"]) for e in got} == {("u0", 3), ("u1", 4)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_turn_queries_hold_every_session(spark):
    want = folded()
    got = {(r["session_id"], r["turn_no"], r["uuid"], r["assistant"]) for r in QUERIES["transcript_turns"](spark, DATA).collect()}
    assert got == {(s, n, u, turns_cut("\n".join(said))) for s, ts in want.items() for n, (u, _, said) in enumerate(ts, 1)}
    ahead = {(r["session_id"], r["turn_no"], r["uuid"]) for r in QUERIES["turn_feedback"](spark, DATA).collect()}
    assert ahead == {(s, n, u) for s, ts in want.items() for n, (u, _, _) in enumerate(ts[:-1], 1)}
    due = {(r["session_id"], r["new_turns"]) for r in QUERIES["summary_due"](spark, DATA).collect()}
    assert due == {(s, len(ts)) for s, ts in want.items() if len(ts) >= 5}
    cursors = {r["session_id"]: r["last_processed_uuid"] for r in pq.read_table(f"{DATA}/session_progress.parquet").to_pylist()}
    after = {(r["session_id"], r["turn_no"]) for r in QUERIES["turns_after_cursor"](spark, DATA).collect()}
    seen = {s: next((n for n, (u, _, _) in enumerate(ts, 1) if u == cursors.get(s)), 0) for s, ts in want.items()}
    assert after == {(s, n) for s, ts in want.items() for n in range(seen[s] + 1, len(ts) + 1)}


def turns_cut(text):
    return text[:4000] + turns.CUT_MARK if len(text) > 4000 else text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_episodes_hold_the_calls_of_their_interval(spark):
    at = {}
    for r in pq.read_table(f"{DATA}/observations.parquet", columns=["session_id", "ts"]).to_pylist():
        if r["session_id"] is not None and r["ts"] is not None:
            at.setdefault(r["session_id"], []).append(time_us(r["ts"].isoformat()))
    want = set()
    for s, ts in folded().items():
        open_ = [(time or 0, n, u, after) for n, ((u, time, _), (_, after, _)) in enumerate(zip(ts, ts[1:], strict=False), 1) if after is not None]
        own = [max((o for o in open_ if o[0] <= t), default=None) for t in at.get(s, ())]
        own = [o[1:3] for o, t in zip(own, at.get(s, ()), strict=True) if o and t < o[3]]
        want |= {(s, n, u, own.count((n, u))) for n, u in own if own.count((n, u)) >= 3}
    assert {tuple(r) for r in QUERIES["episode_steps"](spark, DATA).select("session_id", "turn_no", "uuid", "calls").collect()} == want != set()
