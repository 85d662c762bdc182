"""Frequent ordered patterns with gaps across many sequences (problem 6).

Level-wise: patterns of length k + 1 are joined from frequent patterns of length k that overlap in k - 1
steps; candidates with an infrequent contiguous subpattern are pruned (a bounded gap makes only contiguous
subpatterns anti-monotone: leaving out an inner step widens a gap). The candidates of a level form a hash
tree, which is broadcast, and every sequence is walked through it.

Skew. The events of all sequences are put in one global order by range partitioning on (sequence, time,
id), so a sequence that holds a third of all rows is split like any other. The ordered rows are cut into
chunks of ``chunk_rows`` plus the few rows that a match begun in the chunk may still reach
((max_between + 1) * (longest - 1)); a chunk is one row of a stored table, and each level is a scan of it.
Sequences wholly inside a chunk are counted there; only the two at its ends send (sequence, pattern) rows.

Bounds of what reaches the driver and is broadcast: the frequent patterns of a level, at most the mean
number of distinct patterns in a sequence divided by ``min_support``; one offset for each partition.

Defined cases: rows whose sequence or step is null or blank are ignored; steps are trimmed and
lower-cased; rows equal in sequence, time, step and payload (null equal to null) count once, at the
smallest id; equal times are ordered by id; null times come first; no rows give no patterns. A pattern
counts once for a sequence, and its steps may repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import globally_ordered
from ..runtime import materialise

Pattern = tuple[int, ...]


def join_candidates(frequent: list[Pattern]) -> list[Pattern]:
    """Patterns one step longer whose prefix and suffix are both frequent."""
    by_prefix: dict[Pattern, list[Pattern]] = {}
    for b in frequent:
        by_prefix.setdefault(b[:-1], []).append(b)
    known = set(frequent)
    joined = (a + b[-1:] for a in frequent for b in by_prefix.get(a[1:], ()))
    return sorted(c for c in joined if all(c[i : i + len(c) - 1] in known for i in range(2)))


class CandidateTree:
    """Candidates as a tree whose edges are found by hash: (node, step) -> node."""

    def __init__(self, candidates: list[Pattern], n_steps: int):
        self.n_steps, self.depth = n_steps, len(candidates[0])
        edges: dict[int, int] = {}
        leaf_of: dict[int, int] = {}
        nodes = 1
        for i, c in enumerate(candidates):
            node = 0
            for s in c:
                key = node * n_steps + s
                if key not in edges:
                    edges[key], nodes = nodes, nodes + 1
                node = edges[key]
            leaf_of[node] = i
        self.nodes = nodes
        order = np.array(sorted(edges), np.int64)
        self.keys, self.targets = order, np.array([edges[k] for k in order.tolist()], np.int64)
        self.leaf = np.full(nodes, -1, np.int64)
        for node, i in leaf_of.items():
            self.leaf[node] = i

    def step(self, nodes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The children reached, -1 where there is none."""
        wanted = nodes * self.n_steps + steps
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (steps >= 0), self.targets[at], -1)

    def matches(self, codes: np.ndarray, runs: np.ndarray, own: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (run, candidate) of matches that begin in the first ``own`` rows; neighbours lie at most ``reach`` apart."""
        pos = np.arange(own)
        node = self.step(np.zeros(own, np.int64), codes[:own])
        first = runs[:own]
        pos, node, first = pos[node >= 0], node[node >= 0], first[node >= 0]
        for _ in range(self.depth - 1):
            states = []
            for d in range(1, reach + 1):
                at = pos + d
                ok = at < len(codes)
                ok[ok] = runs[at[ok]] == first[ok]
                child = self.step(node[ok], codes[at[ok]])
                states.append((at[ok][child >= 0] * self.nodes + child[child >= 0]))
            state = np.unique(np.concatenate(states)) if states else np.array([], np.int64)
            pos, node = state // self.nodes, state % self.nodes
            first = runs[pos]
        found = np.unique(first * len(self.leaf) + node)
        return found // len(self.leaf), self.leaf[found % len(self.leaf)]


def ordered_events(df: DataFrame, sequence: str, time: str, step: str, payload: str, row_id: str) -> DataFrame:
    """(sequence, time, id, step), cleaned and without rows logged again; stored."""
    clean = df.select(F.col(sequence).alias("sequence"), F.col(time).alias("time"), F.lower(F.trim(step)).alias("step"), F.col(row_id).alias("id"), F.sha2(F.col(payload).cast("string"), 256).alias("payload"))
    clean = clean.filter((F.trim("sequence") != "") & (F.col("step") != ""))
    once = clean.groupBy("sequence", "time", "step", "payload").agg(F.min("id").alias("id")).drop("payload")
    return materialise(once, "events")


def sequence_chunks(events: DataFrame, steps: DataFrame, overlap: int, chunk_rows: int) -> DataFrame:
    """One row a chunk: its rows' sequences and step codes in order, own rows first, then at most ``overlap`` more."""
    coded = events.join(F.broadcast(steps), "step", "left").select("sequence", "time", "id", F.coalesce("code", F.lit(-1)).alias("code"))
    dense = globally_ordered(coded, ["sequence", "time", "id"], ["sequence", "code"], "placed")
    chunk, within = F.floor(F.col("place") / chunk_rows), F.col("place") % chunk_rows
    homes = F.when((within < overlap) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    rows = dense.select("place", "sequence", "code", F.explode(homes).alias("chunk"))
    grouped = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "sequence", "code"))).alias("rows"), F.count_if(F.floor(F.col("place") / chunk_rows) == F.col("chunk")).alias("own"))
    return materialise(grouped.select("own", F.col("rows.sequence").alias("sequences"), F.col("rows.code").alias("codes")), "chunks")


def count_candidates(chunks: DataFrame, candidates: list[Pattern], n_steps: int, reach: int) -> DataFrame:
    """(candidate, support): in how many sequences each candidate occurs."""
    tree = chunks.sparkSession.sparkContext.broadcast(CandidateTree(candidates, n_steps))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sequences, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                names = sequences.values.dictionary_encode()
                index = names.indices.to_numpy(zero_copy_only=False)
                runs = np.concatenate([[0], np.cumsum(index[1:] != index[:-1])]).astype(np.int64)
                run, candidate = tree.value.matches(codes.values.to_numpy(zero_copy_only=False).astype(np.int64), runs, own, reach)
                open_run = (run == 0) | (run >= runs[own - 1])
                inner = np.bincount(candidate[~open_run], minlength=0)
                some = np.flatnonzero(inner)
                begins = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
                at_ends = names.dictionary.take(pa.array(index[begins[run[open_run]]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, candidate[open_run]]), pa.int64()), pa.concat_arrays([pa.nulls(len(some), pa.string()), at_ends.cast(pa.string())]), pa.array(np.concatenate([inner[some], np.ones(open_run.sum())]).astype(np.int64), pa.int64())], names=["candidate", "sequence", "n"])

    found = chunks.select("own", "sequences", "codes").mapInArrow(walk, "candidate long, sequence string, n long")
    # a sequence cut by chunks counts once however many of its chunks have the pattern: the most of any chunk is 1
    return found.groupBy("candidate", "sequence").agg(F.when(F.col("sequence").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n")).groupBy("candidate").agg(F.sum("n").alias("support"))


def frequent_sequences(df: DataFrame, sequence: str = "session_id", time: str = "ts", step: str = "tool_name", payload: str = "tool_input_json", row_id: str = "id", min_support: float = 0.2, lengths: tuple[int, ...] = (3, 4), max_between: int = 3, chunk_rows: int = 8192) -> DataFrame:
    """(pattern, support) of every pattern of the given lengths that at least ``min_support`` of the sequences contain."""
    spark = df.sparkSession
    nothing = spark.createDataFrame([], "pattern string, support long")
    events = ordered_events(df, sequence, time, step, payload, row_id)
    n_sequences = events.select(F.countDistinct("sequence")).first()[0]
    if not n_sequences:
        return nothing
    need = max(1, math.ceil(n_sequences * min_support - 1e-9))
    common = events.select("step", "sequence").distinct().groupBy("step").agg(F.count("*").alias("support")).filter(F.col("support") >= need)
    steps = sorted((r["step"], r["support"]) for r in common.collect())
    names = [s for s, _ in steps]
    if not names:
        return nothing
    reach = max_between + 1
    chunks = sequence_chunks(events, spark.createDataFrame([(s, i) for i, s in enumerate(names)], "step string, code int"), reach * (max(lengths) - 1), chunk_rows)
    found = [((i,), n) for i, (_, n) in enumerate(steps)]
    kept = [(p, n) for p, n in found if len(p) in lengths]
    for _ in range(2, max(lengths) + 1):
        candidates = join_candidates([p for p, _ in found])
        if not candidates:
            break
        counted = count_candidates(chunks, candidates, len(names), reach).filter(F.col("support") >= need)
        found = sorted((candidates[r["candidate"]], r["support"]) for r in counted.collect())
        kept += [(p, n) for p, n in found if len(p) in lengths]
    return spark.createDataFrame([(">".join(names[i] for i in p), n) for p, n in kept], "pattern string, support long")
