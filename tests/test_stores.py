import datetime as dt
import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell import providers
from tracewell import schemas as S
from tracewell.functions import redact
from tracewell.operators import events, recall
from tracewell.plans import pipelines
from tracewell.runtime import big_join, clear_scratch, materialise

T0 = dt.datetime(2031, 3, 1)


def greedy(rows, window=300):
    last, kept = {}, set()
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= window:
            last[key] = at
            kept.add(i)
    return kept


def test_batches_keep_what_one_batch_keeps(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.randint(0, 4000)) for i in range(300)] + [(900 + i, "hot", 30 * i) for i in range(100)]
    df = spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s), "extra") for i, k, s in rows], "id long, k string, ts timestamp, _key string").drop("_key")
    state, got = None, set()
    for a, b in ((0, 700), (700, 710), (710, 2500), (2500, 99_999)):
        part = df.filter((F.col("ts") >= T0 + dt.timedelta(seconds=a)) & (F.col("ts") < T0 + dt.timedelta(seconds=b)))
        kept = materialise(events.dedup_windowed(part, ["k"], state=state), "kept")
        state = events.dedup_state(kept, ["k"], before=state)
        got |= {x["id"] for x in kept.collect()}
    assert got == greedy(rows)
    assert state.count() == 4 and events.dedup_state(df.limit(0), ["k"]).count() == 0
    assert {x["id"] for x in events.dedup_windowed(df.limit(0), ["k"], state=state).collect()} == set()


def test_state_runs_out(spark):
    df = spark.createDataFrame([(1, "a", T0), (2, "b", T0 + dt.timedelta(hours=2))], "id long, k string, ts timestamp")
    assert events.dedup_state(df, ["k"]).count() == 1


def test_observe_in_two_batches(spark):
    call = lambda i, at: (i, "s", T0 + dt.timedelta(seconds=at), "Bash", json.dumps({"command": "x"}), "r")
    frame = lambda *rows: spark.createDataFrame(list(rows), S.OBSERVATION)
    store, state = pipelines.observe(frame(call(1, 0)), frame(), T0)
    store, state = pipelines.observe(frame(call(2, 10), call(3, 400)), materialise(store, "store"), T0, state)
    assert sorted(r["id"] for r in store.collect()) == [1, 3]


def test_sensitive_path_in_any_content_column(spark):
    rows = [(1, '{"file_path": "/a.py"}', '{"path": "/x/.env"}'), (2, '{"x": {"filename": "/k/id_rsa"}}', None), (3, None, "text"), (4, '{"path": "/b"}', '{"path": "/c"}')]
    df = spark.createDataFrame(rows, "id int, tool_input_json string, tool_response_summary string")
    got = {r["id"]: r["p"] for r in df.select("id", redact.sensitive_path("tool_input_json", "tool_response_summary").alias("p")).collect()}
    assert got == {1: "/x/.env", 2: "/k/id_rsa", 3: None, 4: None}


def test_named_providers():
    said = []

    def transport(url, headers, body, timeout):
        said.append((url, body["model"]))
        return {"choices": [{"message": {"content": "{}"}}], "content": [{"type": "text", "text": "{}"}], "data": [{"index": 0, "embedding": [1.0]}]}

    for name, key in (("openai", "OPENAI_API_KEY"), ("DeepSeek", "DEEPSEEK_API_KEY"), ("anthropic", "ANTHROPIC_API_KEY")):
        assert isinstance(providers.analyser({"LLM_PROVIDER": name}, transport), providers.RuleAnalyser)
        assert providers.analyser({"LLM_PROVIDER": name, key: "k"}, transport).analyze("x") == {"instincts": [], "project_facts": []}
        assert said[-1][0].startswith("https://api.") and said[-1][1]
    made = providers.analyser({"LLM_PROVIDER": "openai", "OPENAI_API_KEY": "k", "OPENAI_BASE_URL": "http://x/", "OPENAI_MODEL": "m"}, transport)
    made.analyze("x")
    assert said[-1] == ("http://x/chat/completions", "m")
    assert isinstance(providers.embedder({"EMBEDDING_PROVIDER": "openai"}, transport), providers.TfidfEmbedder)
    assert providers.embedder({"EMBEDDING_PROVIDER": "openai", "OPENAI_EMBEDDING_API_KEY": "k"}, transport).embed(["x"]) == [[1.0]]

    def broken(*_):
        raise providers.ProviderError("down")

    assert isinstance(providers.embedder({"EMBEDDING_PROVIDER": "ark", "ARK_API_KEY": "k"}, broken), providers.TfidfEmbedder)


def test_one_index_for_many_questions(spark):
    r = random.Random(1)
    texts = {i: " ".join(r.choice(["cache", "worker", "merge", "the", "stale", "x1", "y2"]) for _ in range(r.randint(0, 8))) for i in range(40)} | {100: None, 101: "", 102: "a b"}
    index = recall.TfidfIndex(spark.createDataFrame(list(texts.items()), "id long, text string"))
    words = lambda t: Counter(re.findall(r"\w{2,}", (t or "").lower()))
    for question in ("cache the worker", "unseen words", "stale stale x1", "!"):
        bags = {**{i: words(t) for i, t in texts.items()}, "q": words(question)}
        df = Counter(w for b in bags.values() for w in b)
        weigh = lambda b: {w: n * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, n in b.items()}  # noqa: B023, E731
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        q = weigh(bags["q"])
        expected = {}
        for i in texts:
            v = weigh(bags[i])
            expected[i] = sum(x * q.get(w, 0) for w, x in v.items()) / (size(v) * size(q)) if v and q else 0.0
        assert {x["id"]: x["score"] for x in index.scores(question).collect()} == pytest.approx(expected)
        best = sorted(texts, key=lambda i: (-round(expected[i], 9), i))[:12]
        assert [x["id"] for x in index.top(question, k=12).orderBy("rank").collect()] == best


def test_big_join_is_never_a_broadcast(spark):
    a, b = spark.range(10), spark.range(10).withColumn("x", F.lit(1))
    for how in ("inner", "left", "left_semi", "left_anti", "full"):
        plan = big_join(a, b, "id", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scratch_is_cleared(spark):
    path = materialise(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clear_scratch(spark)
    assert not os.path.exists(path)
