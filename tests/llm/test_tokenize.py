import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm.tokenize import DEFAULT_VOCABULARY, WordContractor, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")
CONTRACTOR = []


def ours(texts):
    if not CONTRACTOR:
        CONTRACTOR.append(WordContractor())
    offsets, flat = CONTRACTOR[0].encode(texts)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def theirs(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    assert ours(texts) == theirs(texts)


def test_long_runs_and_scripts():
    texts = ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "-=" * 2000, "<|endoftext|>", "日本語のテキスト" * 200, "it's\r\n\t 12345 ", "é" * 400, "é" * 300, "😀🏽" * 100, " 　x"]
    assert ours(texts) == theirs(texts)


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (None, "x", "x")]
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()), key=repr)
    assert got == sorted([(i, theirs([t])[0] if t else []) for i, t, _ in rows], key=repr)
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_round_trip(spark):
    texts = ["hello world", "日本語 it's\r\n\t 12345 ", "😀🏽 é e\u0301", " " * 300, "", None, "a" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in decode_corpus(encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in decode_corpus(empty).collect()] == [""] and decode_corpus(empty.limit(0)).count() == 0
