import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tracewell import providers, schemas as S
from tracewell.plans import pipelines
from tracewell.sources import frontmatter, logs, store
from tracewell.streaming import dedup

T0 = dt.datetime(2031, 3, 1)


def test_frontmatter_round_trip(spark, tmp_path):
    head = {"id": "a", "confidence": 0.7000000000000002, "hit_count": 4, "deprecated": False, "trigger": "it's: a [test] # x", "last_seen": "2031-03-01", "keywords": ["a b", "c:d"], "scope": None}
    (tmp_path / "a.md").write_text(frontmatter.format_frontmatter(head, "body\n\n---\nmore"), encoding="utf-8")
    (tmp_path / "no-head.md").write_text("only text", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("x")
    assert frontmatter.parse_frontmatter((tmp_path / "a.md").read_text()) == (head, "body\n\n---\nmore")
    rows = {r["id"]: r for r in frontmatter.read_entities(spark, str(tmp_path), S.INSTINCT).collect()}
    assert set(rows) == {"a", "no-head"} and rows["a"]["confidence"] == 0.7000000000000002 and rows["a"]["last_seen"] == dt.date(2031, 3, 1) and rows["no-head"]["trigger"] is None
    assert frontmatter.read_entities(spark, str(tmp_path / "missing"), S.MEMORY).count() == 0


def test_folded_and_flow_values():
    head, body = frontmatter.parse_frontmatter("---\r\na: one\r\n  two\r\nk: [x, 'y, z']\r\ne:\r\n---\r\nb")
    assert head == {"a": "one two", "k": ["x", "y, z"], "e": ""} and body == "b"


def test_log_scans(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"session_id": "s", "ts": "2031-03-01T00:00:00Z", "tool_name": "A", "tool_input": null, "tool_response": "r"}\nnot json\n[1]\n')
    (r,) = logs.events(spark, str(tmp_path / "e.json")).collect()
    assert (r["session_id"], r["ts"], r["tool_input_json"]) == ("s", T0, "{}")
    (tmp_path / "t.jsonl").write_text('{"type": "user", "uuid": "u", "timestamp": 5, "message": {"content": "a b"}}\n\nbad\n[1]\n{"type": "x"}\n', encoding="utf-8")
    rows = logs.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("line_no").collect()
    assert [(r["line_no"], r["type"], r["timestamp"]) for r in rows] == [(0, "user", None), (4, "x", None)] and json.loads(rows[0]["message"])["content"] == "a b"
    assert logs.transcript(spark, str(tmp_path / "none")).count() == logs.transcript(spark, "").count() == 0
    for text, n in (('[{"session_id": "a"}]', 1), ("{}", 0), ("[cut", 0)):
        path = tmp_path / f"{n}{len(text)}.json"
        path.write_text(text)
        assert logs.json_table(spark, str(path), "session_id STRING").count() == n
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    assert {tuple(r) for r in logs.json_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}
    assert logs.json_map(spark, str(tmp_path / "none")).count() == 0 and logs.document(spark, str(tmp_path / "none")).first()[0] == ""
    assert logs.build_query(str(tmp_path)) == tmp_path.name
    assert logs.by_id(spark.createDataFrame([("a",)], "id string"), "b").count() == 0


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), S.RECENT_SESSION)
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", T0, "1"), ("b", T0, "1")], S.RECENT_SESSION), "session_id")
    for n in range(3):
        t.upsert(spark.createDataFrame([("a", T0, str(n))], S.RECENT_SESSION), "session_id")
    assert {(r["session_id"], r["summary_excerpt"]) for r in t.read().collect()} == {("a", "2"), ("b", "1")}
    assert len(list((tmp_path / "t").glob("v-*"))) == 2


def test_state_and_documents(spark, tmp_path):
    state = spark.createDataFrame([("old", "2031-02-28T22:00:00Z"), ("new", "2031-02-28T23:30:00Z"), ("odd", "?")], "key string, value string")
    assert {r["key"] for r in store.live_state(state, T0).collect()} == {"new", "odd"}
    store.write_document(spark.createDataFrame([("a\nb",)], "text string"), str(tmp_path / "d"))
    assert logs.document(spark, str(tmp_path / "d")).first()[0].strip() == "a\nb"


def chat(text):
    return lambda url, headers, body, timeout: {"choices": [{"message": {"content": text}}]}


def test_analysers():
    assert [f["name"] for f in providers.RuleAnalyser().analyze("run pnpm i; yarn")["project_facts"]] == ["uses-pnpm", "uses-yarn"]
    assert isinstance(providers.analyser({"LLM_PROVIDER": "chat"}), providers.RuleAnalyser)
    made = providers.analyser({"LLM_PROVIDER": " CHAT ", "LLM_API_KEY": "k", "LLM_URL": "http://x"}, chat('{"instincts": [{"id": "a"}, 3]}'))
    assert made.analyze("x") == {"instincts": [{"id": "a"}], "project_facts": []}
    with pytest.raises(providers.ProviderError):
        providers.ChatAnalyser("u", "k", "m", transport=chat("not json")).analyze("x")
    with pytest.raises(providers.ProviderError):
        providers.ChatAnalyser("u", "k", "m", transport=lambda *a: {}).summarize("a", "b")
    blocks = providers.MessagesAnalyser("u", "k", "m", transport=lambda *a: {"content": [{"type": "text", "text": '```json\n{"task_type": "t"}\n```'}]})
    assert blocks.mine_procedure("s", "a") == {"task_type": "t"}
    assert providers.ChatAnalyser("u", "k", "m", transport=chat("null")).mine_procedure("s", "a") is None


def test_embedders():
    shuffled = lambda url, h, body, t: {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}
    assert providers.BatchEmbedder("u", "k", "m", transport=shuffled).embed(["a", "b", "c"]) == [[0.0], [1.0], [2.0]]
    assert providers.BatchEmbedder("u", "k", "m", transport=lambda *a: 1 / 0).embed([]) == []
    for data in ({"embedding": [1]}, [{"embedding": [1]}]):
        assert providers.ItemEmbedder("u", "k", "m", transport=lambda *a, d=data: {"data": d}).embed(["x"]) == [[1.0]]
    env = {"EMBEDDING_PROVIDER": "Batch", "EMBEDDING_API_KEY": "k"}
    assert isinstance(providers.embedder(env, shuffled), providers.BatchEmbedder)
    assert isinstance(providers.embedder(env, lambda *a: {}), providers.TfidfEmbedder) and isinstance(providers.embedder({}), providers.TfidfEmbedder)
    a, b = providers.TfidfEmbedder().embed(["x yy zz", "yy"])
    assert sum(x * x for x in a) == pytest.approx(1) and len(a) == len(b) == 2


def calls(spark, rows):
    return spark.createDataFrame([(i, s, T0 + dt.timedelta(seconds=at), tool, json.dumps(v), r) for i, (s, at, tool, v, r) in enumerate(rows)], S.OBSERVATION)


def test_observe(spark):
    rows = [("s", 0, "Bash", {"command": "x", "token": "token=abc"}, "password: p"), ("s", 10, "Bash", {"token": "token=abc", "command": "x"}, "r"), ("s", 20, "Read", {"file_path": "/x/.env"}, "K=V")]
    got = {r["id"]: r for r in pipelines.observe(calls(spark, rows), spark.createDataFrame([], S.OBSERVATION), T0 + dt.timedelta(days=1))[0].collect()}
    assert set(got) == {0, 2} and "abc" not in got[0]["tool_input_json"] and got[2]["tool_response_summary"].startswith("<REDACTED")


def test_extract_and_context(spark):
    rows = [("s", i, "Bash", {"command": f"pnpm run {i}"}, None) for i in range(3)]
    instincts, memories, rules, cursors = pipelines.extract(calls(spark, rows), spark.createDataFrame([], S.INSTINCT), spark.createDataFrame([], S.MEMORY), T0.date())
    assert [(r["id"], r["confidence"]) for r in instincts.collect()] == [("no-auto-commit-pattern", 0.5)]
    assert [r["id"] for r in memories.collect()] == ["uses-pnpm"]
    assert cursors.first()["last_processed_id"] == 2 and rules.count() == 1
    context = pipelines.recall_context(instincts, memories, "recap", "pnpm", providers.TfidfEmbedder())
    assert "pnpm" in json.loads(context.first()[0])["additionalContext"]


class Miner:
    def mine_procedure(self, steps, assistant, feedback=""):
        if "boom" in steps:
            raise RuntimeError
        return {"id": "do-it", "task_type": "do it", "steps": ["a"], "is_successful": True}

    def summarize(self, previous, new_turns):
        if "bad" in new_turns:
            raise RuntimeError
        return "done"


def test_mining_and_summaries(spark):
    t = spark.createDataFrame([("s", 1, "u1", "p", "a", T0), ("s", 2, "u2", "q", "b", T0 + dt.timedelta(seconds=100)), ("s", 3, "u3", "r", "c", T0 + dt.timedelta(seconds=200)), ("one", 1, "x", "bad", "", T0)], S.TURN)
    seen = calls(spark, [("s", i, "A", {}, None) for i in range(3)] + [("s", 100 + i, "A", {"x": "boom"}, None) for i in range(3)])
    procedures, messages, cursors = pipelines.mine_procedures(t, seen, spark.createDataFrame([], S.PROCEDURE), T0.date(), Miner)
    assert [(r["id"], r["hit_count"], r["confidence"]) for r in procedures.collect()] == [("do-it", 1, 0.55)] and messages.count() == 0
    assert {tuple(r) for r in cursors.collect()} == {("s", "u2")}
    done, at = pipelines.summarise(t, "", make=Miner, threshold=1)
    assert {tuple(r) for r in done.collect()} == {("s", "done")} and {tuple(r) for r in at.collect()} == {("s", "u3")}
    prompt, flagged = pipelines.notify(procedures.withColumn("status", F.lit("promoted")))
    assert prompt.count() == 1 and flagged.first()["skill_asked"] is True and pipelines.notify(flagged)[0].count() == 0
    rows, text = pipelines.record_session(spark.createDataFrame([], S.RECENT_SESSION), "s", T0, "sum")
    assert rows.count() == 1 and "sum" in text.first()[0] and pipelines.record_session(rows, None, T0, "x")[0].count() == 1


def run_stream(spark, make, tmp_path, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one state server instead of four
    q = make.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name)


def test_stream_dedup_equals_batch_fold_and_marks_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "id long, ts timestamp, tool string"
    parts = [[(0, 0), (1, 299), (2, 300)], [(3, 500), (4, 600), (5, 250)]]
    for n, part in enumerate(parts):
        spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), "A") for i, s in part], schema).coalesce(1).write.mode("append").json(str(folder / str(n)))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "*"))
    got = {(r["id"], r["late"]) for r in run_stream(spark, dedup.dedup_stream(stream, ["tool"]), tmp_path, "kept").collect()}
    assert got == {(0, False), (2, False), (4, False), (5, True)}


def test_stream_summary_trigger(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([("a", "turn")] * 3 + [("b", "turn"), ("b", "SessionEnd"), ("c", "turn"), ("d", "PreCompact")], "session_id string, event string").coalesce(1).write.json(str(folder))
    stream = spark.readStream.schema("session_id string, event string").json(str(folder))
    assert {tuple(r) for r in run_stream(spark, dedup.summary_triggers(stream, 3), tmp_path, "due").collect()} == {("a", 3, False), ("b", 1, True)}


def test_stream_append_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(1, now), (2, now - dt.timedelta(days=60))], "id long, ts timestamp").write.json(str(folder))
    stream = dedup.within_retention(spark.readStream.schema("id long, ts timestamp").json(str(folder)))
    for checkpoint in ("c1", "c2"):  # the same batch again, as after a lost commit
        dedup.append_batches(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
