import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import redact, text, vectors


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()[0]


LONG = {"a": "A" * 24, "b": "b" * 40}


@pytest.mark.parametrize(
    "given, expected",
    [
        (f"key sk-{LONG['a']} end", "key ***REDACTED*** end"),
        (f"ark-{LONG['a']}", "***REDACTED***"),
        ("API_KEY = abc def", "***REDACTED*** def"),
        ("token:x", "***REDACTED***"),
        (f"ghp_{LONG['b']}", "***REDACTED***"),
        ("AKIA" + "Z" * 16, "***REDACTED***"),
        ("bearer  a.b-c_d!", "***REDACTED***!"),
        ("token: Bearer x", "***REDACTED*** x"),
        ("password = x", "***REDACTED***"),
        ("plain", "plain"),
        ("", ""),
        (None, None),
    ],
)
def test_redact_text(spark, given, expected):
    assert one(spark, redact.redact_text("v"), given) == expected


def test_redact_strict_takes_the_value_after_the_scheme(spark):
    assert one(spark, redact.redact_text("v", strict=True), "token: Bearer x") == "***REDACTED***"


def test_redact_nested_values_but_not_keys(spark):
    kind = T.StructType([T.StructField("env", T.MapType(T.StringType(), T.StringType())), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("n", T.IntegerType())])
    df = spark.createDataFrame([(({"token=a": "token=b"}, ["x", "password: y"], 3),)], T.StructType([T.StructField("v", kind)]))
    r = df.select(redact.redact_value(F.col("v"), kind).alias("x")).first()[0]
    assert r["env"] == {"token=a": redact.MASK} and r["args"] == ["x", redact.MASK] and r["n"] == 3


def test_redact_json_keeps_it_json(spark):
    given = {"a": [{"b": "token=x y"}, 1, None], "token": "t"}
    assert json.loads(one(spark, redact.redact_json("v"), json.dumps(given))) == {"a": [{"b": redact.MASK + " y"}, 1, None], "token": "t"}
    assert one(spark, redact.redact_json("v"), '{"cut": "token=x') == '{"cut": "' + redact.MASK
    assert one(spark, redact.redact_json("v"), None) is None


@pytest.mark.parametrize("path, hit", [(".env", True), ("/p/to/.ENV", True), ("id.pem", True), ("aws_credentials.json", True), ("x.keyboard", True), ("normal.py", False), ("", False), (None, False)])
def test_sensitive_path(spark, path, hit):
    assert one(spark, redact.is_sensitive_path("v"), path) is hit


@pytest.mark.parametrize("value, path", [({"path": "b", "file_path": "a"}, "a"), ({"x": {"filename": "c"}}, "c"), ({"x": [{"path": "d"}]}, None), ({"path": 3}, None), ({"path": ""}, ""), ([], None)])
def test_first_path(spark, value, path):
    assert one(spark, redact.first_path("v"), json.dumps(value)) == path


def test_mask_records(spark):
    df = spark.createDataFrame([("Read", '{"file_path": "/a/.env"}', "secret text", "token=a"), ("Read", '{"file_path": "/a/b.py"}', "token=z", "token=a")], "tool_name string, tool_input_json string, tool_response_summary string, note string")
    rows = redact.mask_records(df, redact.first_path("tool_input_json"), ["tool_input_json", "tool_response_summary"]).orderBy("file").collect()
    kept, masked = rows
    assert masked["file"] == "/a/.env" and masked["tool_response_summary"] == redact.SENSITIVE_MASK and masked["note"] == "token=a"
    assert kept["file"] is None and kept["tool_response_summary"] == redact.MASK and kept["note"] == redact.MASK


def test_cuts_count_characters(spark):
    assert one(spark, text.cut("v", 3, "..."), "日本語字") == "日本語..."
    assert one(spark, text.cut("v", 4, "..."), "日本語字") == "日本語字"
    assert one(spark, text.cut("v", 4), None) is None


@pytest.mark.parametrize("given, expected", [(" Fix the  Cache! ", "fix-the-cache"), ("保留 中文", "保留-中文"), ("a" * 100, "a" * 80)])
def test_slug(spark, given, expected):
    assert one(spark, text.slug("v"), given) == expected


def test_slug_of_marks_is_a_hash(spark):
    assert one(spark, text.slug("v"), "!!!") == hashlib.md5(b"!!!").hexdigest()[:8]


@pytest.mark.parametrize("given, expected", [("good-id-1", "good-id-1"), ("Bad Id", "fallback"), (None, "fallback"), ("-x", "fallback")])
def test_kebab_id(spark, given, expected):
    assert one(spark, text.kebab_id("v", F.lit("Fallback")), given) == expected


@pytest.mark.parametrize("a, b, score", [("abc", "abd", 0.5), ("a b c", "abc", 1.0), ("", "abc", 0.0), ("ABC", "abc", 0.0), ("日本😀", "日😀", 2 / 3), (None, "a", 0.0)])
def test_character_similarity(spark, a, b, score):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(text.character_similarity("a", "b")).first()[0]
    assert r == pytest.approx(score)


def test_keywords_texts_and_labels(spark):
    assert one(spark, text.normal_keywords("v"), [" A ", "", None, "b"], "array<string>") == ["a", "b"]
    assert one(spark, text.normal_keywords("v"), None, "array<string>") == []
    df = spark.createDataFrame([(None, ["a", "b"]), ("x", None)], "body string, k array<string>")
    assert [r[0] for r in df.select(text.cacheable_text("body", "k")).collect()] == [" a b", "x "]
    assert one(spark, text.fact_label("v"), "error") == "[error]" and one(spark, text.fact_label("v"), None) == "[user]"
    assert one(spark, text.named_managers("v"), "use pnpm and yarn, not xnpm") == ["pnpm", "yarn"]
    assert one(spark, text.publishes("v"), "cd x && git push") is True and one(spark, text.publishes("v"), None) is False


@pytest.mark.parametrize("value, expected", [('"abcdef"', "abc"), ('{"a": 1}', None), ("3", None)])
def test_response_summary_of_strings_only(spark, value, expected):
    assert one(spark, text.response_summary(F.parse_json("v"), 3), value) == expected


def test_prompt_and_spoken_text(spark):
    prompt = text.is_typed_prompt(F.lit("user"), F.try_parse_json("v"))
    assert [one(spark, prompt, m) for m in ('{"content": "x"}', '{"content": [1]}', '{"content": 3}', "[]", "cut{")] == [True, False, False, False, False]
    said = text.spoken_text(F.try_parse_json("v"))
    blocks = json.dumps({"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": "b"}, 7]})
    assert one(spark, said, blocks) == "a\nb" and one(spark, said, '{"content": "s"}') == "s" and one(spark, said, "{}") == ""


def test_call_key_ignores_layout(spark):
    keys = {one(spark, text.call_key(F.lit("Bash"), "v"), v) for v in ('{"a":1,"b":[2]}', '{ "b": [2], "a": 1 }')}
    assert keys == {hashlib.sha256(('Bash:' + json.dumps({"a": 1, "b": [2]}, sort_keys=True)).encode()).hexdigest()}
    assert one(spark, text.call_key(F.lit(None).cast("string"), "v"), None) == hashlib.sha256(b":{}").hexdigest()


def test_vector_distances(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(5.0, 0.0), (pytest.approx(5**0.5), 0.0)]
