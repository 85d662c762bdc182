import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell import schemas as S
from tracewell.functions.text import characters
from tracewell.operators import components, confidence, detect, events, matching, merge, ordering, progress, recall, render, turns

T0 = dt.datetime(2031, 3, 1)
TODAY = dt.date(2031, 3, 2)
CALL = "id BIGINT, session_id STRING, ts TIMESTAMP, tool_name STRING, tool_input_json STRING, tool_response_summary STRING"


def calls(spark, rows):
    """rows: (session, seconds, tool, input)."""
    return spark.createDataFrame([(i, s, None if at is None else T0 + dt.timedelta(seconds=at), tool, i_ if i_ is None or isinstance(i_, str) else json.dumps(i_), None) for i, (s, at, tool, i_) in enumerate(rows)], CALL)


def test_greedy_dedup_is_a_fold(spark):
    r = random.Random(3)
    rows = [("s", r.randint(0, 4000), r.choice("AB"), {"k": r.randint(0, 2)}) for _ in range(400)] + [("s", None, "A", {}), ("s", 0, None, None), ("s", 299, None, None), ("s", 300, None, None)]
    df = calls(spark, rows)
    kept, last = set(), {}
    for i, (_, at, tool, value) in sorted(enumerate(rows), key=lambda x: (x[1][1] if x[1][1] is not None else -1, x[0])):
        key = (tool, json.dumps(value))
        if at is None:
            kept.add(i)
        elif key not in last or at - last[key] >= 300:
            last[key] = at
            kept.add(i)
    assert {x["id"] for x in events.dedup_windowed(df, ["tool_name", "tool_input_json"]).collect()} == kept


def test_retention_and_scans(spark):
    df = calls(spark, [("s", 0, "A", {}), ("s", 86400 * 40, "A", {}), ("t", 86400 * 41, "A", {})])
    now = F.lit(T0 + dt.timedelta(days=42))
    assert [r["id"] for r in events.retained(df, now).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in events.new_observations(df, "s", 0).collect()] == [1]
    assert [r["id"] for r in events.observations_between(df, F.lit(T0), F.lit(T0 + dt.timedelta(days=40))).collect()] == [0]
    assert [r["id"] for r in events.observations_between(df, F.lit(T0 + dt.timedelta(days=40)), session="t").collect()] == [2]
    late = calls(spark, [("s", 0, "A", {})])
    assert events.appended(df.limit(0), late, T0 + dt.timedelta(days=31)).count() == 0


def test_running_count_over_small_chunks(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, f boolean")
    got = {(x["g"], x["o"]): x["running"] for x in ordering.running_count(df, "g", ["o"], ["g", "o"], F.col("f"), "t", chunk_rows=7).collect()}
    for g in "ab":
        n = 0
        for _, o, f in sorted(x for x in rows if x[0] == g):
            n += f
            assert got[g, o] == n


def test_carried_and_previous_over_small_chunks(spark):
    rows = [("a" if i < 90 else "b", i, i if i % 11 == 0 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {x["o"]: x["v"] for x in ordering.carried_forward(df, "g", ["o"], ["g", "o", "v"], ["v"], "t", chunk_rows=5).collect()}
    assert got == {i: (i // 11 * 11 if (i < 90 or i // 11 * 11 >= 90) else None) for i in range(120)}
    before = {x["o"]: [p["o"] for p in x["previous"]] for x in ordering.with_previous(df, "g", ["o"], ["g", "o"], 3, "t", chunk_rows=5).collect()}
    assert before == {i: [j for j in range(i - 1, i - 4, -1) if j >= (0 if i < 90 else 90)] for i in range(120)}


def line(session, n, type_, uuid, content, ts="2031-03-01T00:00:00Z"):
    return (session, n, type_, uuid, ts, content if isinstance(content, str) and content[:1] in "{[" else json.dumps({"content": content}))


LINE = "session_id STRING, line_no INT, type STRING, uuid STRING, timestamp STRING, message STRING"


def test_turns(spark):
    said = lambda *t: [{"type": "text", "text": x} for x in t]
    rows = [
        line("s", 0, "assistant", "a0", said("before any prompt")),
        line("s", 1, "user", "u1", "first"),
        line("s", 2, "assistant", "a1", said("one", "two")),
        line("s", 3, "user", "r1", [{"type": "tool_result", "content": "x"}]),
        line("s", 4, "assistant", "a2", said("three")),
        line("s", 5, "user", "", "ignored, no uuid"),
        line("s", 6, "user", "u2", "x" * 5000),
        line("s", 7, "system", "y", "no"),
        ("s", 8, "assistant", "bad", "t", '{"content": [{"ty'),
    ]
    got = turns.turns(spark.createDataFrame(rows, LINE)).orderBy("turn_no").collect()
    assert [(t["uuid"], t["user"][:5], t["assistant"]) for t in got] == [("u1", "first", "one\ntwo\nthree"), ("u2", "xxxxx", "")]
    assert got[1]["user"] == "x" * 4000 + turns.CUT_MARK
    t = turns.turns(spark.createDataFrame(rows, LINE))
    cursor = lambda u: spark.createDataFrame([("s", u)], "session_id string, last_processed_uuid string")
    assert [x["uuid"] for x in turns.turns_after(t, cursor("u1")).collect()] == ["u2"]
    assert turns.turns_after(t, cursor(None)).count() == turns.turns_after(t, cursor("gone")).count() == 2
    assert [(x["uuid"], x["next_user"][:1]) for x in turns.with_feedback(t).collect()] == [("u1", "x")]
    assert turns.release_cursors(t).first()["last_processed_uuid"] == "u1"
    assert "### Turn 1 (uuid: u1)\n[user]\nfirst\n[assistant]\none" in turns.turns_text(t).first()["text"]


def test_episodes(spark):
    at = lambda s: (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = [line("s", i, "user", f"u{i}", f"p{i}", at(100 * i)) for i in range(3)]
    observed = calls(spark, [("s", 0, "Read", {"a": 1}), ("s", 50, None, None), ("s", 99, "Bash", {"x": "y" * 200}), ("s", 100, "Edit", {}), ("s", 101, "Edit", {}), ("t", 5, "Edit", {})])
    got = turns.episodes(turns.turns(spark.createDataFrame(rows, LINE)), observed).collect()
    assert [(e["uuid"], e["calls"], e["next_user"]) for e in got] == [("u0", 3, "p1")]
    steps = got[0]["steps"].split("\n")
    assert steps[0] == '1. Read: {"a": 1}' and steps[1] == "2. unknown: {}" and steps[2].endswith("...") and len(steps[2]) == len("3. Bash: ") + 150 + 3


def test_read_before_edit(spark):
    f = {"file_path": "/a"}
    rows = [("s", 1, "Read", f), ("s", 2, "Edit", f), ("s", 3, "Read", {"file_path": "/b"}), ("s", 4, "X", {}), ("s", 5, "X", {}), ("s", 6, "X", {}), ("s", 7, "Write", {"file_path": "/b"}), ("s", 8, "Edit", {}), ("s", 9, "Edit", '"a string"'), ("t", 1, "Read", f), ("u", 2, "Edit", f)]
    got = {r["session_id"]: (r["edits"], r["read_first"]) for r in detect.edits_after_reads(calls(spark, rows)).collect()}
    assert got == {"s": (2, 1), "u": (1, 0)}


@pytest.mark.parametrize("commands, found", [(["a", "b", "c"], True), (["a", "b", "git commit -m x"], False), (["a", "b"], False), ([], False)])
def test_no_commit_detector(spark, commands, found):
    got = detect.detect_patterns(calls(spark, [("s", i, "Bash", {"command": c}) for i, c in enumerate(commands)]))
    assert [r["id"] for r in got.collect()] == (["no-auto-commit-pattern"] if found else [])


def test_compat_drops_sessions_with_odd_input(spark):
    rows = [("s", i, "Bash", {"command": "a"}) for i in range(3)] + [("s", 9, "Read", '"masked"')]
    assert detect.detect_patterns(calls(spark, rows)).count() == 1
    assert detect.detect_patterns(calls(spark, rows), compat=True).count() == 0


def test_session_digest(spark):
    rows = [("s", i, "B", {"n": i}) for i in range(5)] + [("s", 9, None, None), ("s", 10, "A", {"x": "y" * 300})]
    text = detect.session_digest(calls(spark, rows)).first()["digest"].split("\n")
    assert text[0] == detect.DIGEST_HEAD % 7
    assert text[1:5] == [detect.DIGEST_TOOL % ("B", 5), *[detect.DIGEST_EXAMPLE + json.dumps({"n": i}) for i in range(3)]]
    assert text[5] == detect.DIGEST_TOOL % ("unknown", 1) and text[-1].endswith("...")


def test_confidence_steps_round_as_stored(spark):
    df = spark.createDataFrame([("a", i, True) for i in range(4)] + [("b", 0, False), ("c", 0, None)] + [("d", i, True) for i in range(20)], "k string, o int, hit boolean")
    got = {r["k"]: (r["confidence"], r["hits"], r["signals"]) for r in confidence.fold_confidence(df, ["k"], ["o"]).collect()}
    assert got == {"a": (0.7000000000000002, 4, 4), "b": (0.45, 0, 1), "c": (0.45, 0, 1), "d": (0.9, 20, 20)}
    row = spark.createDataFrame([(0.88, True), (0.55, False)], "c double, h boolean").select(confidence.after(F.col("c"), F.col("h"))).collect()
    assert [r[0] for r in row] == [0.9, 0.5]
    many = confidence.decayed(spark.createDataFrame([(0.55,)], "confidence double"), F.lit(20)).first()[0]
    assert many < 0


def instincts(spark, rows):
    return spark.createDataFrame([(i, d, t, c, 1, x, TODAY, "project", "b") for i, d, t, c, x in rows], S.INSTINCT)


def test_promoted(spark):
    df = instincts(spark, [("a", "g", "t", 0.7, None), ("a-b", "g", "t", 0.7, False), ("z", "g", "t", 0.9, False), ("x", "g", "t", 0.95, True), ("y", "g", "t", 0.69, False)])
    assert [r["id"] for r in confidence.promoted(df).collect()] == ["z", "a-b", "a"]
    text = render.rules_text(confidence.promoted(df)).first()[0]
    assert text.startswith(render.RULES_HEAD) and "- **t** (confidence: 0.90, domain: g)" in text


def test_best_matches_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh xyz日本") for _ in range(r.randint(0, 9)))
    c = [(i, i, word(), r.choice(["g", "h", "", None])) for i in range(120)]
    q = [(1000 + i, word(), r.choice(["g", "h", "", None])) for i in range(30)]
    queries, candidates = spark.createDataFrame(q, "query_id long, text string, gate string"), spark.createDataFrame(c, "match_id long, ord long, text string, gate string")

    def score(a, b):
        a, b = set(a.replace(" ", "")), set(b.replace(" ", ""))
        return len(a & b) / len(a | b) if a and b else 0

    for gated in (True, False):
        expected = {}
        for i, t, g in q:
            best = max(((score(t, x), -o, m) for m, o, x, h in c if (not gated or (g and g == h)) and score(t, x) >= 0.45), default=None)
            if best:
                expected[i] = (best[2], pytest.approx(best[0]))
        got = {x["query_id"]: (x["match_id"], x["score"]) for x in matching.best_text_matches(queries, candidates, gated=gated).collect()}
        assert got == expected
    assert matching.best_text_matches(queries.limit(0), candidates).count() == 0


def test_keyword_matches_need_a_shared_keyword(spark):
    q = spark.createDataFrame([(1, "fix cache", [" A ", ""]), (2, "fix cache", ["z"]), (3, "fix cache", None)], "query_id long, text string, keywords array<string>")
    c = spark.createDataFrame([(7, 0, "fix caches", ["a"]), (8, 1, "fix cache", ["b"]), (9, 2, "qqq", ["a"])], "match_id long, ord long, text string, keywords array<string>")
    assert [(r["query_id"], r["match_id"]) for r in matching.best_keyword_matches(q, c).collect()] == [(1, 7)]


def test_components(spark):
    links = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), ("e", "4"), ("d", "4")], "node string, key string")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_merge_instincts(spark):
    store = instincts(spark, [("fix-cache", "git", "fix the cache", 0.6, True), ("other", "", "zzz", 0.5, False)])
    rows = [
        (0, "new-id", "fix the caches", "do", "git", "seen"),  # similar in its domain, revives
        (1, "other", "nothing alike 123", "", "testing", None),  # by id
        (2, "Fresh One", "brand new words", "", "", None),  # new, id made of the trigger
        (3, "x", "  ", "", "git", None),  # no trigger
        (4, "y", "brand new words!", "", "", None),  # blank domain: only by id, so new
    ]
    got = {r["id"]: r for r in merge.merge_instincts(store, spark.createDataFrame(rows, S.INSTINCT_CANDIDATE), TODAY).collect()}
    assert set(got) == {"fix-cache", "other", "brand-new-words", "y"}
    assert got["fix-cache"]["confidence"] == 0.65 and got["fix-cache"]["hit_count"] == 2 and got["fix-cache"]["deprecated"] is False and got["fix-cache"]["trigger"] == "fix the caches"
    assert got["other"]["domain"] == "testing" and got["brand-new-words"]["confidence"] == 0.5 and got["y"]["hit_count"] == 1


def test_merge_sees_earlier_candidates(spark):
    rows = [(i, "", "watch the queue" + "!" * i, "", "git", None) for i in range(4)]
    got = merge.merge_instincts(spark.createDataFrame([], S.INSTINCT), spark.createDataFrame(rows, S.INSTINCT_CANDIDATE), TODAY).collect()
    assert [(r["hit_count"], r["confidence"]) for r in got] == [(4, 0.6500000000000001)]


def test_merge_facts(spark):
    store = spark.createDataFrame([("uses-npm", "project", ["npm"], "the project uses npm", dt.date(2031, 1, 1), "b")], S.MEMORY)
    rows = [(0, "x", "the project uses npm!", None, None, ["NPM "]), (1, "y-z", "the project uses npm", "body", "error", ["other"]), (2, "q", "", None, None, ["npm"])]
    got = {r["id"]: r for r in merge.merge_facts(store, spark.createDataFrame(rows, S.FACT_CANDIDATE), TODAY).collect()}
    assert set(got) == {"uses-npm", "y-z"}
    assert got["uses-npm"]["created"] == TODAY and got["uses-npm"]["body"] == "the project uses npm!" and got["uses-npm"]["type"] == "project"


def procedure(spark, status, conf, hits=1, asked=True):
    return spark.createDataFrame([("add-provider", "add a provider", hits, conf, status, asked, TODAY, TODAY, ["old"], "b")], S.PROCEDURE)


def candidate(spark, ok=True, task="add a provider"):
    return spark.createDataFrame([(0, "s1", "x-y", task, ["a", "b"], "note", ok)], S.PROCEDURE_CANDIDATE)


@pytest.mark.parametrize(
    "stored, ok, expected",
    [
        (None, True, ("x-y", 1, 0.55, "candidate", False)),
        (None, False, ("x-y", 1, 0.45, "candidate", False)),
        (("candidate", 0.5), True, ("add-provider", 2, 0.55, "candidate", False)),
        (("candidate", 0.68), True, ("add-provider", 2, 0.7300000000000001, "promoted", True)),
        (("promoted", 0.7), False, ("add-provider", 2, 0.6499999999999999, "promoted", False)),
        (("deprecated", 0.5), True, ("add-provider", 2, 0.55, "candidate", False)),
    ],
)
def test_merge_procedures(spark, stored, ok, expected):
    store = procedure(spark, *stored) if stored else spark.createDataFrame([], S.PROCEDURE)
    (r,) = merge.merge_procedures(store, candidate(spark, ok), TODAY).collect()
    assert (r["id"], r["hit_count"], r["confidence"], r["status"], r["promoted_now"]) == (expected[0], expected[1], pytest.approx(expected[2], abs=1e-12), expected[3], expected[4])
    assert r["skill_asked"] is (False if not stored or stored[0] == "deprecated" else True)
    assert r["evidence_sessions"] == (["old", "s1"] if stored else ["s1"])


PROGRESS = [("idle", "p", "u1", "idle", T0), ("busy", "p", "u2", "processing", T0 - dt.timedelta(seconds=599)), ("stale", "p", "u3", "Processing", T0 - dt.timedelta(seconds=600)), ("odd", None, None, None, None)]


def test_leases(spark):
    table = spark.createDataFrame(PROGRESS, S.PROGRESS)
    wanted = spark.createDataFrame([(s,) for s in ("idle", "busy", "stale", "new", "new")], "session_id string")
    after, claims = progress.claim(table, wanted, T0)
    assert {r["session_id"]: (r["claimed"], r["cursor"]) for r in claims.collect()} == {"idle": (True, "u1"), "busy": (False, None), "stale": (True, "u3"), "new": (True, None)}
    assert {r["session_id"]: r["status"] for r in after.collect()} == {"idle": "processing", "busy": "processing", "stale": "processing", "new": "processing", "odd": None}
    assert [r["session_id"] for r in progress.orphans(table, F.lit(T0), me="x").collect()] == ["stale"]
    assert progress.orphans(table, F.lit(T0), me="stale").count() == 0
    freed = progress.release(after, spark.createDataFrame([("idle", "u9"), ("stale", None)], "session_id string, last_processed_uuid string"), T0)
    assert {(r["session_id"], r["last_processed_uuid"], r["status"]) for r in freed.filter("session_id in ('idle', 'stale')").collect()} == {("idle", "u9", "idle"), ("stale", "u3", "idle")}


def test_recent_sessions(spark):
    stored = spark.createDataFrame([(f"s{i:02}", T0 + dt.timedelta(days=i), "x" * 300) for i in range(12)], S.RECENT_SESSION)
    ended = spark.createDataFrame([("s00", T0 + dt.timedelta(days=99), "new"), ("", T0, "none"), (None, T0, "none")], S.RECENT_SESSION)
    got = progress.recent_sessions(stored, ended).collect()
    assert len(got) == 10 and (got[0]["session_id"], got[0]["summary_excerpt"]) == ("s00", "new") and len(got[1]["summary_excerpt"]) == 200
    assert render.recent_text(progress.recent_sessions(stored, ended)).first()[0].count("## ") == 10


def test_due_for_summary(spark):
    t = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 1)], "session_id string, turn_no int")
    assert [r["session_id"] for r in progress.due_for_summary(t, threshold=3).collect()] == ["a"]
    forced = spark.createDataFrame([("b",), ("c",)], "session_id string")
    assert sorted(r["session_id"] for r in progress.due_for_summary(t, forced, 3).collect()) == ["a", "b"]


def test_pending_prompts_once(spark):
    df = procedure(spark, "promoted", 0.8, asked=None).unionByName(procedure(spark, "candidate", 0.8, asked=False).withColumn("id", F.lit("c")))
    assert "add a provider" in render.pending_prompts(df).first()[0]
    asked = render.mark_asked(df, ["add-provider", "missing"])
    assert render.pending_prompts(asked).count() == 0


def test_context_json(spark):
    none = spark.createDataFrame([], "rank int, type string, description string, body string")
    assert render.context_json(" ", instincts(spark, []), none).count() == 0
    memories = spark.createDataFrame([(1, "odd", "", "body"), (2, "error", "d", "b")], "rank int, type string, description string, body string")
    got = json.loads(render.context_json("sum", instincts(spark, [("i", "git", "t", 0.8, False)]), memories).first()[0])
    assert got["additionalContext"] == "[project-recap]\nsum\n[habit][git] t\n[user] body\n[error] d"
    assert "[memory] 2" in got["systemMessage"]


def test_merged_config_is_idempotent():
    template = json.dumps({"hooks": {"Stop": [{"run": "${PROJECT_DIR}/a.py"}, {"run": "b"}]}})
    once = render.merged_config(template, json.dumps({"x": 1, "hooks": {"Stop": [{"run": "b"}]}}), "sub")
    assert json.loads(once) == {"x": 1, "hooks": {"Stop": [{"run": "b"}, {"run": "${PROJECT_DIR}/sub/a.py"}]}}
    assert render.merged_config(template, once, "sub") == once


class Counting:
    supports_cache, name = True, "count"

    def embed(self, texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]


def test_vector_cache(spark):
    cache = spark.createDataFrame([("same", "count", __import__("hashlib").sha256(b"aa").hexdigest(), [9.0, 9.0]), ("changed", "count", "old", [1.0, 1.0]), ("fails", "count", "old", [2.0, 2.0]), ("gone", "count", "x", [3.0, 3.0])], S.VECTOR)
    items = spark.createDataFrame([("same", "aa"), ("changed", "bbb"), ("fails", "fail"), ("fresh", "c"), ("never", "fail too")], "memory_id string, text string")
    assert {r["memory_id"] for r in recall.cache_misses(items, cache, "count").collect()} == {"changed", "fails", "fresh", "never"}
    got = {r["memory_id"]: (list(r["embedding"]), r["stale"]) for r in recall.sync_vectors(items, cache, Counting().embed, "count").collect()}
    assert got == {"same": ([9.0, 9.0], False), "changed": ([3.0, 1.0, 0.0, 0.0], False), "fails": ([2.0, 2.0], True), "fresh": ([1.0, 1.0, 0.0, 0.0], False)}


def test_recall(spark):
    memories = spark.createDataFrame([("a", "aaaa", []), ("b", "zz", ["k"]), (None, "x", None)], "id string, body string, keywords array<string>")
    assert [r["id"] for r in recall.recall_top_k(memories.filter("id is not null"), "xxxxx", Counting(), 1).collect()] == ["a"]
    assert recall.recall_top_k(memories, "fail", Counting()).count() == 0
    from tracewell.providers import TfidfEmbedder

    assert [r["id"] for r in recall.recall_top_k(memories.filter("id is not null"), "the zz", TfidfEmbedder(), 1).collect()] == ["b"]
    assert recall.recall_top_k(memories.limit(0), "zz", TfidfEmbedder()).count() == 0


def test_knn_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(99, None), (98, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for x in recall.knn(df.filter("id < 5").withColumnRenamed("id", "query_id"), df, k=3).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["id"]
    for q in range(5):
        best = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][1], v, strict=True)) ** 0.5, 6), i) for i, v in rows if v and len(v) == 4)[:3]
        assert got[q] == {n: i for n, (_, i) in enumerate(best, 1)}


def test_characters_column(spark):
    assert spark.range(1).select(characters(F.lit("b a b"))).first()[0] == ["a", "b"]
