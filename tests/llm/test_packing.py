import os
import random

import numpy as np
import pytest

from tracewell.llm.packing import DEFAULT_RANKS, best_fit, limits_of, pack, token_counts, window_report

WINDOWS = [("short", 640), ("long", 5000)]


def sizes(spark, values):
    return spark.createDataFrame([(i, n, "clash") for i, n in values], "doc_id long, tokens long, window_id string")


def check(rows, values, capacity):
    """Whole documents, windows within capacity; the number of windows."""
    by_window, pieces = {}, {}
    for r in rows:
        by_window.setdefault(r["window_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
    for w, items in by_window.items():
        assert sum(r["tokens"] for r in items) <= capacity and len(items) <= limits_of(capacity)[0]
        assert len([r for r in items if r["tokens"]]) <= 1 or sum(r["tokens"] ** 2 for r in items) <= limits_of(capacity)[1]
    for i, n in values:
        parts = sorted(pieces[i])
        assert sum(t for _, _, t in parts) == n and [f for _, f, _ in parts] == [capacity * k for k in range(len(parts))]
        assert len(parts) == 1 or n > capacity
    return len(by_window)


@pytest.mark.parametrize("per_group", [50, 4000])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_windows_are_valid_and_well_filled(spark, per_group, score):
    r = random.Random(1)
    values = [(i, int(r.expovariate(1 / 1200))) for i in range(600)] + [(1000 + i, 0) for i in range(40)] + [(2000, 50000), (2001, 640), (2002, 5000)]
    rows = pack(sizes(spark, values), WINDOWS, items_per_group=per_group, score=score).collect()
    for name, capacity in WINDOWS:
        mine = [x for x in rows if x["window_name"] == name]
        used = check(mine, values, capacity)
        least = sum(n for _, n in values) / capacity
        assert used <= least * 1.12 + 3
    for r in window_report(spark.createDataFrame(rows), WINDOWS).collect():
        assert r["documents"] == len(values) and not (r["over"] or r["cut_needlessly"] or r["torn"])


def test_no_documents_and_no_windows(spark):
    assert pack(sizes(spark, []), WINDOWS).count() == 0
    assert pack(sizes(spark, [(1, 5)]), [("none", 0), (None, 5)]).count() == 0


def test_repeated_and_null_ids(spark):
    rows = pack(sizes(spark, [(None, 100), (None, 100), (1, 600), (1, 600)]), [("short", 640)]).collect()
    assert len(rows) == 4 and sum(r["tokens"] for r in rows) == 1400


def test_best_fit_prefers_the_tightest_window():
    windows = best_fit(np.array([60, 50, 40, 10]), 100, 10, 10**6)
    assert windows.tolist() == [0, 1, 0, 1]
    assert len(set(best_fit(np.array([1] * 10), 100, 2, 10**6).tolist())) == 5  # documents are a capacity too
    assert len(set(best_fit(np.array([6, 6]), 100, 10, 50).tolist())) == 2  # and so is attention


@pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary here")
def test_token_counts(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a" * 100_000)]
    got = {r["doc_id"]: r["tokens"] for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000


def test_every_capacity_binds():
    sizes_ = np.sort(np.random.default_rng(2).integers(1, 2000, 900))[::-1]
    limits = limits_of(2048)
    free = best_fit(sizes_, 2048, 10**6, 10**12)
    for documents, attention in ((2, 10**12), (10**6, int(2048**2 * 0.6))):
        assert best_fit(sizes_, 2048, documents, attention).tolist() != free.tolist()
    window = best_fit(sizes_, 2048, *limits)
    for w in np.unique(window):
        inside = sizes_[window == w]
        assert inside.sum() <= 2048 and len(inside) <= limits[0] and (len(inside) == 1 or (inside**2).sum() <= limits[1])
    assert len(set(best_fit(np.array([99, 1]), 100, 10, 9000).tolist())) == 2  # the long one takes all attention
    assert len(set(best_fit(np.array([99, 0]), 100, 10, 9000).tolist())) == 1


def test_report_sees_what_is_wrong(spark):
    rows = [("short", "a", 1, 0, 0, 600), ("short", "a", 2, 0, 0, 100), ("short", "b", 3, 0, 0, 10), ("short", "c", 3, 1, 20, 10)]
    df = spark.createDataFrame(rows, "window_name string, window_id string, doc_id long, piece int, first_token long, tokens long")
    r = window_report(df, WINDOWS).first()
    assert (r["documents"], r["over"], r["cut_needlessly"], r["torn"]) == (3, 1, 1, 1)
