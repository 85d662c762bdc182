import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm.subjects import INSPECTED, SUBJECTS, bag_of_words, digamma, document_subjects, infer, subject_of_topics
from tracewell.runtime import table

FOLDER = "/root/testdata/sf0.01"


def test_bags():
    lang, bag = bag_of_words("The tele-\nscope of the obſer­\nver, and the 3 comets")
    assert lang == "en" and bag["telescope"] == 1 and bag["observer"] == 1 and "3" not in bag
    assert bag_of_words(None)[0] is bag_of_words("")[0] is bag_of_words("日本語 999")[0] is None
    assert bag_of_words("der Mond und die Erde")[0] == "de"


def test_digamma():
    assert np.allclose(digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525891])


def test_inference_keeps_the_tokens():
    free = np.array([[0.5, 0.5, 1e-9], [1e-9, 1e-9, 1.0]])
    mass, term, share = infer(pa.array([[0, 1], [2], [0, 2]], pa.list_(pa.int32())), pa.array([[3, 1], [5], [1, 1]], pa.list_(pa.int32())), free, 0.1, 20)
    assert np.allclose(mass.sum(1), [4, 5, 2]) and mass[0, 0] > 3.9 and mass[1, 1] > 4.9 and term.tolist() == [0, 1, 2, 0, 2] and share.shape == (5, 2)


def test_topics_are_named_by_their_top_terms():
    vocabulary = sorted({w for s in ("law", "sport") for w in INSPECTED[s]["en"].split()} | {"mayor", "street"})
    place = {w: i for i, w in enumerate(vocabulary)}
    weights = np.zeros((3, len(vocabulary)))
    for k, words in enumerate((INSPECTED["sport"]["en"].split(), INSPECTED["law"]["en"].split(), ["mayor", "street"])):
        weights[k, [place[w] for w in words]] = 1
    assert subject_of_topics(weights, vocabulary, "en", top=2) == ["sport", "law", None]


def test_made_up_pages(spark):
    r = random.Random(2)
    common = "mayor street town letter window garden bridge winter morning council".split()
    own = {s: INSPECTED[s]["en"].split() + [f"{s}{c}x" for c in "abcdefghij"] for s in SUBJECTS}
    rows, truth = [], {}
    for i in range(900):
        mine = r.sample(SUBJECTS, r.choice([0, 1, 1, 2]))
        text = [r.choice("the of and his".split()) for _ in range(30)] + [r.choice(common) for _ in range(30)] + [r.choice(own[s]) for s in mine for _ in range(20)] + [r.choice(own[r.choice(SUBJECTS)])]
        r.shuffle(text)
        rows.append((i, " ".join(text), "xx", "clash"))
        truth[i] = set(mine)
    rows += [(9000, None, None, ""), (9001, "", None, ""), (9002, " \n", None, ""), (9003, "日本語", None, ""), (None, rows[1][1], None, ""), (1, rows[1][1], None, ""), (9004, "the judge " * 40_000, None, "")]
    got = {}
    found = [tuple(x) for x in document_subjects(spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")).collect()]
    assert len(found) == len(set(found))
    for i, s in found:
        got.setdefault(i, set()).add(s)
    good = sum(len(truth[i] & got.get(i, set())) for i in truth)
    assert good / sum(map(len, truth.values())) > 0.95 and good / sum(len(got.get(i, ())) for i in truth) > 0.95
    assert not {9000, 9001, 9002, 9003} & set(got)


def test_copies_and_frequent_subjects_keep_their_words(spark):
    """A third of the rows is one page about law, and half of the distinct pages are about sport."""
    r = random.Random(7)
    common = [f"common{c}x" for c in "abcdefghijklmnopqrstuvwxyz"]
    page = lambda s: " ".join(["the of and his"] * 5 + [r.choice(common) for _ in range(10)] + INSPECTED[s]["en"].split() * 3)
    rows, truth = [], {}
    for i in range(400):
        truth[i] = r.choice(["sport", r.choice(SUBJECTS)])
        rows.append((i, page(truth[i])))
    copied = page("law")
    rows += [(1000 + i, copied) for i in range(200)]
    truth |= {1000 + i: "law" for i in range(200)}
    got = {tuple(x) for x in document_subjects(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([x for x in got if x[0] >= 1000 and x[1] == "law"]) == 200
    assert len(got & set(truth.items())) > 0.95 * len(truth) and len(got - set(truth.items())) < 0.05 * len(truth)


def test_no_documents(spark):
    assert document_subjects(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_hand_labelled_documents(spark):
    got, labels = {}, {}
    for r in document_subjects(table(spark, FOLDER, "documents")).collect():
        got.setdefault(r[0], set()).add(r[1])
    for r in table(spark, FOLDER, "doc_subjects").collect():
        labels.setdefault(r[0], set()).add(r[1].strip().lower())
    good = sum(len((s - {"none"}) & got.get(i, set())) for i, s in labels.items())
    assert good / sum(len(s - {"none"}) for s in labels.values()) > 0.9 and good / sum(len(got.get(i, ())) for i in labels) > 0.9
