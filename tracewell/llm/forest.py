"""Near-duplicate records by a MinHash LSH forest (problem 3).

1. Records with the same words form a class; one representative stands for all copies from here on.
2. Each of ``trees`` tries holds one label of min-hashes of every representative. A trie is stored as its
   sorted labels, cut into subtries that share the shortest prefix which may be needed; that is the longest one
   whose recall at the similarity threshold, 1 - (1 - s^length)^trees, reaches ``target_recall``. Labels are
   ``deeper`` min-hashes longer than it.
3. Matched prefixes are shortened step by step, from whole labels on. A step meets the pairs of a subtrie
   whose labels agree in exactly that many min-hashes - runs of the sorted labels -, leaves out those whose sizes
   or parity sketches rule the similarity out, and verifies the others on their words. A verified pair of similarity s was due to be met with probability
   p(s) = 1 - (1 - s^length)^trees, so it stands for 1 / p(s) pairs; a relation takes no further step once
   its verified pairs are ``target_recall`` of the upper estimate of all (two standard errors, and three
   unseen pairs at the threshold). Few pairs give no such certainty and go down to the shortest prefix.

The verified pairs of representatives and the class of every record are the result (``near_duplicates``).
``expand_pairs`` lists all pairs of records where a caller needs them.

Scale: labels are two numbers each, made in Arrow batches and shuffled once; subtries of one record are dropped
and no step shuffles the others again, only the pairs met. A subtrie that a third of all records share is
a third of one of ``trees`` tries; it is read as a sorted stream and stored in blocks of ``block`` labels, and
the blocks of one subtrie meet each other as separate rows. No join broadcasts a table.

Defined cases: null and blank texts have no words and no pairs; an id that is null is not compared; equal
ids are told apart by their class only; ties do not occur, as all pairs at or above the threshold count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import big_join, materialise
from .words import overlap, word_set

#: Copies of one text are joined to their class in this many parts.
SALTS = 16
#: Bits of a min-hash in a label.
SYMBOL = 12
PAIRS_A_BATCH = 100_000
WORDS_AT_ONCE = 200_000
#: What a label carries.
PAYLOAD = ["cid", "n", "sketch"]


def shortest_prefix(threshold: float, trees: int, target_recall: float) -> int:
    """The longest prefix that still gives the target recall at the threshold."""
    length = 1
    while 1 - (1 - threshold ** (length + 1)) ** trees >= target_recall:
        length += 1
    return length


def forest_labels(words: np.ndarray, starts: np.ndarray, trees: int, shortest: int, deeper: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(subtrie, rest) of each word set in each tree: the tree and its first ``shortest`` min-hashes mixed to one number, and ``deeper`` more side by side.

    ``words`` has the sets one after the other, none of them empty, and ``starts`` where they begin.
    """
    flat = words.view(np.uint64)
    random = np.random.default_rng(seed)
    subtrie, rest = np.empty((len(starts), trees), np.uint64), np.zeros((len(starts), trees), np.uint64)
    mixer = np.uint64(0xBF58476D1CE4E5B9)
    for tree in range(trees):
        node = np.full(len(starts), tree, np.uint64)
        for place in range(shortest + deeper):
            a = random.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
            symbol = (np.minimum.reduceat(flat * a, starts) * mixer) >> np.uint64(64 - SYMBOL)
            if place < shortest:
                node = (node ^ symbol) * mixer
                node ^= node >> np.uint64(29)
            else:
                rest[:, tree] = (rest[:, tree] << np.uint64(SYMBOL)) | symbol
        subtrie[:, tree] = node
    return subtrie.view(np.int64), rest.view(np.int64)


def parity_sketch(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each word set, a bit for the parity of the words that fall on it: two sketches differ in no more bits than the sets in words."""
    bit = np.uint64(1) << ((words.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bit, starts).view(np.int64)


def _entries(batches: Iterator[pa.RecordBatch], trees: int, shortest: int, deeper: int) -> Iterator[pa.RecordBatch]:
    """(subtrie, rest, cid, n, sketch, rel_no) of (rel_no, cid, words), one row a tree; a subtrie belongs to one relation."""
    for batch in batches:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WORDS_AT_ONCE, "right")) - 1)
            starts, flat = offsets[at:end] - offsets[at], lists.values.to_numpy(zero_copy_only=False)[offsets[at] : offsets[end]]
            subtrie, rest = forest_labels(flat, starts, trees, shortest, deeper)
            rel, cid, n = batch.column(0).to_numpy()[at:end], batch.column(1).to_numpy()[at:end], np.diff(offsets[at : end + 1])
            subtrie ^= (rel.astype(np.int64) * 0x2545F4914F6CDD1D)[:, None]
            columns = [subtrie.ravel(), rest.ravel(), *(np.repeat(x, trees) for x in (cid, n, parity_sketch(flat, starts), rel))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["subtrie", "rest", *PAYLOAD, "rel_no"])
            at = end


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted (subtrie, rest, cid, n, sketch, rel_no) as one row for each subtrie and ``block`` labels of it; lone labels are left out."""
    held, number = None, 0

    def rows(columns: list[np.ndarray], ends: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        """Rows of the parts that begin at 0 and end at ``ends``."""
        starts = np.concatenate([[0], ends[:-1]])
        keep = (ends - starts > 1) | (numbers > 0)
        lengths = (ends - starts)[keep]
        at = np.repeat(keep, ends - starts)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[: ends[-1]][at])) for c in columns[1:5]]
        return pa.RecordBatch.from_arrays([pa.array(columns[5][starts[keep]]), pa.array(columns[0][starts[keep]]), pa.array(numbers[keep], pa.int32()), *lists], names=["rel_no", "subtrie", "block", "rest", *PAYLOAD])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        node = columns[0]
        first = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        lengths = np.diff(np.concatenate([first, [len(node)]]))
        before = np.zeros(len(first), np.int64)
        before[0] = number  # blocks of the first subtrie that are written already
        parts = np.maximum(1, -(-lengths // block))
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(first, parts) + np.minimum((inner + 1) * block, np.repeat(lengths, parts))
        numbers = np.repeat(before, parts) + inner
        cut, number = 0, int(numbers[-1])
        if len(ends) > 1:
            yield rows(columns, ends[:-1], numbers[:-1])
            cut = int(ends[-2])
        held = [c[cut:] for c in columns]
    if held is not None:
        yield rows(held, np.array([len(held[0])]), np.array([number]))


def _prefix(rest: np.ndarray, length: int, deeper: int) -> np.ndarray:
    return rest >> (SYMBOL * (deeper - length))


def _fitting(a: list[np.ndarray], b: list[np.ndarray], up: int, down: int) -> pa.RecordBatch:
    """(cid_a, cid_b) of pairs (cid, n, sketch of each) that can be similar: neither their sizes nor their sketches differ too much."""
    (cid_a, n_a, sketch_a), (cid_b, n_b, sketch_b) = a, b
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    fits = (up * n_a <= down * n_b) & (up * n_b <= down * n_a) & (cid_a != cid_b)
    # of sets with similarity up / down at most (n_a + n_b) (down - up) / (down + up) words are in one only
    fits &= np.bitwise_count((sketch_a ^ sketch_b).view(np.uint64)) * np.int64(down + up) <= (n_a + n_b) * (down - up)
    x, y = cid_a[fits], cid_b[fits]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["cid_a", "cid_b"])


def _meet(batches: Iterator[pa.RecordBatch], length: int, deeper: int, up: int, down: int) -> Iterator[pa.RecordBatch]:
    """(cid_a, cid_b) of labels of one block (rest, payload) that agree in exactly ``length`` of the ``deeper`` min-hashes."""
    for batch in batches:
        sizes = np.diff(batch.column(0).offsets.to_numpy())
        rest, *payload = (x.flatten().to_numpy(zero_copy_only=False) for x in batch.columns)
        run_prefix = _prefix(rest, length, deeper)
        row = np.repeat(np.arange(len(sizes)), sizes)
        run = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (run_prefix[1:] != run_prefix[:-1])])) if len(rest) else row
        longer = _prefix(rest, length + 1, deeper) if length < deeper else None
        at, step, a, b, waiting = np.arange(len(rest)), 0, [], [], 0
        while len(at):
            step += 1
            at = at[at + step < len(rest)]
            at = at[run[at] == run[at + step]]
            met = at if longer is None else at[longer[at] != longer[at + step]]
            a.append(met)
            b.append(met + step)
            waiting += len(met)
            if waiting >= PAIRS_A_BATCH or not len(at):
                i, j = np.concatenate(a), np.concatenate(b)
                yield _fitting([x[i] for x in payload], [x[j] for x in payload], up, down)
                a, b, waiting = [], [], 0


def _meet_across(batches: Iterator[pa.RecordBatch], length: int, deeper: int, up: int, down: int) -> Iterator[pa.RecordBatch]:
    """The same for labels of two blocks of one subtrie (rest and payload of each)."""
    for batch in batches:
        half = batch.num_columns // 2
        for i in range(batch.num_rows):
            rest_a, *a = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(half))
            rest_b, *b = (batch.column(half + k)[i].values.to_numpy(zero_copy_only=False) for k in range(half))
            same = _prefix(rest_a, length, deeper)[:, None] == _prefix(rest_b, length, deeper)[None]
            if length < deeper:
                same &= _prefix(rest_a, length + 1, deeper)[:, None] != _prefix(rest_b, length + 1, deeper)[None]
            x, y = np.nonzero(same)
            for k in range(0, len(x), PAIRS_A_BATCH):
                p, q = x[k : k + PAIRS_A_BATCH], y[k : k + PAIRS_A_BATCH]
                yield _fitting([c[p] for c in a], [c[q] for c in b], up, down)


def _unmet(similarity: Column, length: int, trees: int) -> Column:
    """The probability that a pair of this similarity does not meet within ``length`` min-hashes."""
    return F.pow(1 - F.pow(similarity, F.lit(length)), F.lit(trees))


def _sure(links: DataFrame, length: int, trees: int, threshold: float, target_recall: float) -> set[str]:
    """Relations whose links found so far are surely the target share of all; one row a relation reaches the driver."""
    q = _unmet(F.col("similarity"), length, trees)
    sums = links.groupBy("rel").agg(F.count("*").alias("found"), F.sum(q / (1 - q)).alias("missed"), F.sum(q / ((1 - q) * (1 - q))).alias("variance")).collect()
    unseen = 3 / (1 - (1 - threshold**length) ** trees)
    return {r["rel"] for r in sums if r["found"] >= target_recall * (r["found"] + r["missed"] + 2 * r["variance"] ** 0.5 + unseen)}


def near_duplicates(records: DataFrame, threshold: tuple[int, int] = (3, 5), trees: int = 64, deeper: int = 5, target_recall: float = 0.995, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``records`` (rel, row_id, text).

    members: (rel, row_id, class_id), class_id being the least row_id of the records with the same words.
    links: (rel, class_a, class_b), class_a < class_b, of classes whose similarity is at least
    threshold[0] / threshold[1].
    """
    up, down = threshold
    shortest = shortest_prefix(up / down, trees, target_recall)
    sets = records.filter(F.col("row_id").isNotNull()).select("rel", "row_id", word_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sets = materialise(sets.withColumn("key", F.md5(F.concat_ws(" ", F.col("words").cast("array<string>")))), "word_sets")
    rels = sorted(r[0] for r in sets.select("rel").distinct().collect() if r[0] is not None)  # the names of a few relations
    rel_no = F.coalesce(*[F.when(F.col("rel") == name, F.lit(i)) for i, name in enumerate(rels)], F.lit(-1)).alias("rel_no")
    grouped = sets.groupBy("rel", "key").agg(F.min("row_id").alias("class_id"), F.count("*").alias("copies"), F.any_value("words").alias("words"))
    classes = materialise(grouped.select("*", rel_no, F.monotonically_increasing_id().alias("cid")), "classes")
    copied = classes.filter("copies > 1").select("rel", "key", "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = big_join(sets.select("rel", "row_id", "key", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("salt")), copied, ["rel", "key", "salt"], "left")
    members = members.select("rel", "row_id", F.coalesce("class_id", "row_id").alias("class_id"))

    entries = classes.select("rel_no", "cid", "words").mapInArrow(lambda b: _entries(b, trees, shortest, deeper), "subtrie bigint, rest bigint, cid bigint, n int, sketch bigint, rel_no int")
    entries = entries.repartition("subtrie").sortWithinPartitions("subtrie", "rest")
    forest = materialise(entries.mapInArrow(lambda b: _blocks(b, block), "rel_no int, subtrie bigint, block int, rest array<bigint>, cid array<bigint>, n array<int>, sketch array<bigint>"), "forest")
    large = materialise(forest.filter("block > 0").select("subtrie").distinct(), "large_subtries")
    parts = None if large.isEmpty() else materialise(big_join(forest, large, "subtrie", "left_semi"), "large_subtrie_blocks")

    verified, done = None, set()
    for length in range(deeper, -1, -1):
        open_ = ~F.col("rel_no").isin([rels.index(x) for x in done if x is not None]) if done else F.lit(True)
        met = forest.filter(open_).select("rest", *PAYLOAD).mapInArrow(lambda b, k=length: _meet(b, k, deeper, up, down), "cid_a bigint, cid_b bigint")
        if parts is not None:
            other = parts.select("subtrie", *[F.col(c).alias(f"{c}_b") for c in ("block", "rest", *PAYLOAD)])
            across = big_join(parts.filter(open_), other, "subtrie").filter("block < block_b").repartition("subtrie", "block", "block_b").select("rest", *PAYLOAD, "rest_b", *[f"{c}_b" for c in PAYLOAD])
            met = met.unionByName(across.mapInArrow(lambda b, k=length: _meet_across(b, k, deeper, up, down), "cid_a bigint, cid_b bigint"))
        met = met.distinct()
        wa = classes.filter(open_).select(F.col("cid").alias("cid_a"), "rel", F.col("class_id").alias("class_a"), F.col("words").alias("wa"))
        wb = classes.filter(open_).select(F.col("cid").alias("cid_b"), F.col("class_id").alias("class_b"), F.col("words").alias("wb"))
        pairs = big_join(big_join(met, wa, "cid_a"), wb, "cid_b").withColumn("both", overlap("wa", "wb")).withColumn("all", F.size("wa") + F.size("wb") - F.col("both"))
        pairs = pairs.filter(down * F.col("both") >= up * F.col("all")).select("rel", F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), (F.col("both") / F.col("all")).alias("similarity"))
        found = materialise(pairs, "verified")
        # a pair may meet in one tree by a long prefix and in another by a shorter one
        verified = found if verified is None else verified.unionByName(found).distinct()
        if length:
            done = done | _sure(verified, shortest + length, trees, up / down, target_recall)
            if done.issuperset(rels):
                break
    return members, verified.select("rel", "class_a", "class_b")


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rel, row_id_a, row_id_b), a < b: all pairs of records of one class or of linked classes."""
    same = members.filter(F.col("row_id") != F.col("class_id")).select("rel", F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b")).distinct()
    pairs = links.unionByName(same)
    a = members.select("rel", F.col("class_id").alias("class_a"), F.col("row_id").alias("a"))
    b = members.select("rel", F.col("class_id").alias("class_b"), F.col("row_id").alias("b"))
    joined = big_join(big_join(pairs, a, ["rel", "class_a"]), b, ["rel", "class_b"])
    kept = joined.filter((F.col("class_a") != F.col("class_b")) | (F.col("a") < F.col("b")))
    return kept.select("rel", F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))
