import datetime as dt
import random
from itertools import product

import pytest

from tracewell.llm.sequences import CandidateTree, frequent_sequences, join_candidates

CALL = "id long, session_id string, ts timestamp, tool_name string, tool_input_json string, place long, code string"
T0 = dt.datetime(2031, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], CALL)


def expected(rows, share=0.2):
    once = {}
    for i, s, t, tool, x in rows:
        if s and s.strip() and tool and tool.strip():
            key = (s, t, tool.strip().lower(), x)
            once[key] = min(i, once.get(key, i))
    sequences = {}
    for (s, t, tool, _), i in once.items():
        sequences.setdefault(s, []).append((t is not None, t, i, tool))
    found = {}
    for s, rows_ in sequences.items():
        tools = [x[3] for x in sorted(rows_)]
        mine = set()
        for n in (3, 4):
            for start in range(len(tools)):
                for gaps in product(range(1, 5), repeat=n - 1):
                    at, places = start, [start]
                    for g in gaps:
                        at += g
                        places.append(at)
                    if at < len(tools):
                        mine.add(">".join(tools[p] for p in places))
        for p in mine:
            found[p] = found.get(p, 0) + 1
    return {p: n for p, n in found.items() if n >= share * len(sequences)}


@pytest.mark.parametrize("chunk_rows", [20, 8192])
def test_patterns_equal_brute_force(spark, chunk_rows):
    r = random.Random(5)
    rows = []
    for i in range(500):
        session = "hot" if r.random() < 0.35 else f"s{r.randint(0, 25)}"
        rows.append((i, session, T0 + dt.timedelta(seconds=r.randint(0, 300)), r.choice(["Read", "read ", "Edit", "BASH", "Grep"]), r.choice(["{}", None, "x"])))
    rows += [(1000 + k, *rows[k][1:]) for k in range(0, 80, 2)]
    rows += [(2000, None, T0, "Read", ""), (2001, " ", T0, "Read", ""), (2002, "s1", T0, None, ""), (2003, "s1", T0, " ", ""), (2004, "s2", None, "Read", "")]
    got = {x["pattern"]: x["support"] for x in frequent_sequences(frame(spark, rows), chunk_rows=chunk_rows).collect()}
    assert got == expected(rows)


def test_nothing_and_one_session(spark):
    assert frequent_sequences(frame(spark, [])).count() == 0
    rows = [(i, "s", T0 + dt.timedelta(seconds=i), t, None) for i, t in enumerate("aba")]
    assert {tuple(x) for x in frequent_sequences(frame(spark, rows)).collect()} == {("a>b>a", 1)}


def test_candidates_need_frequent_contiguous_parts():
    assert join_candidates([(0, 1), (1, 2), (1, 1)]) == [(0, 1, 1), (0, 1, 2), (1, 1, 1), (1, 1, 2)]
    assert join_candidates([(0, 1)]) == []


def test_tree_finds_only_candidates():
    import numpy as np

    tree = CandidateTree([(0, 1), (1, 2)], 3)
    runs, found = tree.matches(np.array([0, 2, 1, 2]), np.array([0, 0, 0, 1]), 4, 4)
    assert list(zip(runs.tolist(), found.tolist(), strict=True)) == [(0, 0)]
