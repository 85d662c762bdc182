import random
import re

import numpy as np
import pyarrow as pa

from tracewell.llm.forest import _blocks, _sure, expand_pairs, near_duplicates, parity_sketch, shortest_prefix

ROW = "rel string, row_id long, text string, words string, key string"


def words(text):
    return frozenset(re.findall(r"[^\W_]+", (text or "").lower()))


def expected(rows):
    sets = [(rel, i, words(t)) for rel, i, t in rows]
    return {(r, min(i, j), max(i, j)) for x, (r, i, a) in enumerate(sets) for s, j, b in sets[:x] if r == s and a and b and 5 * len(a & b) >= 3 * len(a | b)}


def run(spark, rows, **options):
    members, links = near_duplicates(spark.createDataFrame([(*x, "", "") for x in rows], ROW), **options)
    return members, links, [tuple(r) for r in expand_pairs(members, links).collect()]


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    rows, n = [], 0
    for group in range(60):
        base = [f"w{r.randint(0, 3000)}" for _ in range(40)]
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.choice([0, 1, 4])):
                t[r.randrange(40)] = f"n{r.randint(0, 9000)}"
            if r.random() < 0.3:
                r.shuffle(t)
            rows.append((r.choice(["memories", "memories", "instincts"]), n, " ".join(t)))
            n += 1
    rows += [("memories", 900, None), ("memories", 901, ""), ("memories", 902, " \n"), ("memories", 903, "one"), ("memories", 904, "One!"), ("instincts", 905, "one")]
    members, links, pairs = run(spark, rows)
    assert set(pairs) == expected(rows) and len(pairs) == len(set(pairs))
    assert members.count() == sum(1 for _, _, t in rows if words(t))


def test_copies_are_one_class(spark):
    rows = [("m", i, "the very same text of some words") for i in range(300)] + [("m", 1000 + i, f"other words number {i} {i + 1} {i + 2}") for i in range(50)]
    members, links, pairs = run(spark, rows)
    assert links.filter("class_a = 0 or class_b = 0").count() == 0
    assert {r["class_id"] for r in members.filter("row_id < 300").collect()} == {0}
    assert set(pairs) == expected(rows)


def test_very_long_text_and_no_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    _, _, pairs = run(spark, [("m", 1, long), ("m", 2, long + " more"), ("m", 3, "short")])
    assert pairs == [("m", 1, 2)]
    assert run(spark, [])[2] == []


def test_hot_subtries_are_met_in_blocks(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    rows = [("m", i, " ".join([*base, f"x{i}", f"y{r.randint(0, 9)}"])) for i in range(120)] + [("m", 500 + i, " ".join(f"z{r.randint(0, 500)}" for _ in range(20))) for i in range(60)]
    _, links, pairs = run(spark, rows, block=7)
    assert set(pairs) == expected(rows) and len(pairs) == len(set(pairs)) >= 120 * 119 // 2


def test_blocks_keep_all_labels_but_lone_ones():
    r = np.random.default_rng(1)
    node = np.sort(np.concatenate([np.repeat(7, 25), r.integers(100, 160, 80)]))
    cid = np.arange(len(node))
    columns = [pa.array(node), pa.array(np.zeros(len(node), np.int64)), pa.array(cid), pa.array(np.ones(len(node), np.int32)), pa.array(cid), pa.array(np.zeros(len(node), np.int32))]
    for cut in (1, 4, 1000):
        batches = pa.Table.from_arrays(columns, names=["subtrie", "rest", "cid", "n", "sketch", "rel_no"]).to_batches(cut)
        rows = [x for b in _blocks(iter(batches), 10) for x in b.to_pylist()]
        kept = sorted(c for x in rows for c in x["cid"])
        values, counts = np.unique(node, return_counts=True)
        assert kept == cid[np.isin(node, values[counts > 1])].tolist()
        assert all(len(x["cid"]) <= 10 and {int(node[c]) for c in x["cid"]} == {x["subtrie"]} for x in rows)
        assert sorted(x["block"] for x in rows if x["subtrie"] == 7) == [0, 1, 2]


def test_sketches_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    for _ in range(200):
        pool = r.integers(-(1 << 62), 1 << 62, 60)
        a, b = np.unique(pool[: r.integers(1, 60)]), np.unique(pool[r.integers(0, 40) :])
        x, y = parity_sketch(np.concatenate([a, b]), np.array([0, len(a)])).tolist()
        assert ((x ^ y) & (2**64 - 1)).bit_count() <= len(np.setxor1d(a, b))


def test_prefixes_shorten_until_the_recall_is_reached(spark):
    for trees in (16, 64, 128):
        k = shortest_prefix(0.6, trees, 0.99)
        assert k == 1 or 1 - (1 - 0.6**k) ** trees >= 0.99
        assert 1 - (1 - 0.6 ** (k + 1)) ** trees < 0.99
    links = lambda n, s: spark.createDataFrame([("m", i, i + 1, s) for i in range(n)], "rel string, class_a long, class_b long, similarity double")
    assert _sure(links(5000, 0.9), 6, 64, 0.6, 0.995) == {"m"}
    assert _sure(links(50, 0.9), 6, 64, 0.6, 0.995) == set()  # too few to be sure
    assert _sure(links(5000, 0.62), 8, 64, 0.6, 0.995) == set()  # many are not met yet


def test_no_table_is_broadcast(spark):
    rows = spark.createDataFrame([("m", i, f"some words {i % 7} {i}") for i in range(50)], "rel string, row_id long, text string")
    members, links = near_duplicates(rows)
    assert "BroadcastHashJoin" not in expand_pairs(members, links)._jdf.queryExecution().executedPlan().toString()
