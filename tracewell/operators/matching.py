"""Best match of each query among candidates, by similarity of character sets, with gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters, normal_keywords, set_similarity
from ..runtime import materialise
from ..schemas import SIMILAR_FROM

BLOCK_ROWS = 2000


def _membership(texts: list[str], place: dict[str, int]) -> np.ndarray:
    """One row a text, one column a character; characters without a column are left out."""
    out = np.zeros((len(texts), len(place) or 1), np.float32)
    for i, text in enumerate(texts):
        out[i, [place[c] for c in set(text.replace(" ", "")) if c in place]] = 1
    return out


def best_text_matches(queries: DataFrame, candidates: DataFrame, gated: bool = False, threshold: float = SIMILAR_FROM, others_only: bool = False) -> DataFrame:
    """(query_id, match_id, score): the most similar candidate of each query, the smallest ``ord`` among equals.

    queries: (query_id, text[, gate]); candidates: (match_id, ord, text[, gate]). Similarity is shared over all
    characters, spaces left out, case kept; below ``threshold`` there is no match and no row. With ``gated`` a
    candidate must have the query's gate, and blank or null gates match nothing. With ``others_only`` a row
    does not match the candidate of its own id.

    The queries are a stated set, taken in blocks of ``BLOCK_ROWS``: a block is broadcast - its size is bound by
    the block, not by the data - and every partition of candidates keeps one best row for each query (two
    matrix products a batch), which a partial maximum then reduces. Candidates are never shuffled.
    """
    spark = queries.sparkSession
    id_type, match_type = queries.schema["query_id"].dataType.simpleString(), candidates.schema["match_id"].dataType.simpleString()
    queries = materialise(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), (F.trim("gate") if gated else F.lit("*")).alias("gate")).filter(F.col("gate") != "").withColumn("block", F.monotonically_increasing_id()), "queries")
    candidates = candidates.select("match_id", "ord", F.coalesce("text", F.lit("")).alias("text"), (F.trim("gate") if gated else F.lit("*")).alias("gate")).filter(F.col("gate") != "")
    found = None
    count = queries.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("block"), F.lit(blocks)) == b).select("query_id", "text", "gate").collect()
        if not rows:
            continue
        texts = [r["text"] for r in rows]
        place = {c: i for i, c in enumerate(sorted(set("".join(texts)) - {" "}))}
        gates = {g: i for i, g in enumerate(sorted({r["gate"] for r in rows}))}
        own = {r["query_id"]: i for i, r in enumerate(rows)} if others_only else {}
        block = spark.sparkContext.broadcast((place, _membership(texts, place), np.array([gates[r["gate"]] for r in rows]), gates, own))

        def score(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            place, left, left_gate, gates, own = block.value
            size = left.sum(1)
            best = np.full(len(left), -1.0)
            best_ord = np.zeros(len(left), np.int64)
            best_id: list = [None] * len(left)
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    texts, ids = part.column(2).to_pylist(), part.column(0).to_pylist()
                    ords = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    part_gate = np.array([gates.get(g, -1) for g in part.column(3).to_pylist()])
                    for gate in np.unique(part_gate[part_gate >= 0]):  # the gate comes before any comparison
                        mine, theirs = np.flatnonzero(left_gate == gate), np.flatnonzero(part_gate == gate)
                        theirs = theirs[np.argsort(ords[theirs], kind="stable")]
                        near = [texts[j] for j in theirs]
                        right_size = np.array([len(set(t.replace(" ", ""))) for t in near], np.float64)
                        shared = (left[mine] @ _membership(near, place).T).astype(np.float64)
                        total = size[mine][:, None] + right_size[None] - shared
                        similarity = np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)
                        similarity[similarity < threshold] = -1
                        if own:
                            row_of = {i: k for k, i in enumerate(mine.tolist())}
                            self_pairs = [(row_of[own[ids[j]]], k) for k, j in enumerate(theirs) if own.get(ids[j]) in row_of]
                            if self_pairs:
                                similarity[tuple(np.array(self_pairs).T)] = -1
                        pick = similarity.argmax(1)
                        top, picked = similarity[np.arange(len(mine)), pick], theirs[pick]
                        better = (top > best[mine]) | ((top == best[mine]) & (top >= 0) & (ords[picked] < best_ord[mine]))
                        for k in np.flatnonzero(better).tolist():
                            best[mine[k]], best_ord[mine[k]], best_id[mine[k]] = top[k], ords[picked[k]], ids[picked[k]]
            hit = np.flatnonzero(best >= 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(best[hit]), pa.array(best_ord[hit]), pa.array([best_id[i] for i in hit], kind)], names=["q", "score", "ord", "match_id"])

        local = candidates.mapInArrow(score, f"q long, score double, ord long, match_id {match_type}")
        ids = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"q long, query_id {id_type}")
        best = local.groupBy("q").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", -F.col("ord"))).alias("m"))
        part = best.join(F.broadcast(ids), "q").select("query_id", "m.match_id", "m.score")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"query_id {id_type}, match_id {match_type}, score double")


def best_keyword_matches(queries: DataFrame, candidates: DataFrame, threshold: float = SIMILAR_FROM, others_only: bool = False) -> DataFrame:
    """(query_id, match_id, score): the best candidate that shares a keyword with the query.

    queries: (query_id, text, keywords); candidates: (match_id, ord, text, keywords). Keywords are an inverted
    index, so only pairs that share one are compared, each text as a set made once; the candidates of a frequent
    keyword are salted.
    """
    salts = 8
    q = queries.select("query_id", characters("text").alias("a"), F.explode(F.array_distinct(normal_keywords("keywords"))).alias("keyword")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = candidates.select("match_id", "ord", characters("text").alias("b"), F.explode(F.array_distinct(normal_keywords("keywords"))).alias("keyword")).withColumn("salt", F.pmod(F.xxhash64("match_id"), F.lit(salts)).cast("int"))
    met = q.join(c, ["keyword", "salt"])
    met = met.filter(F.col("query_id") != F.col("match_id")) if others_only else met
    pairs = met.select("query_id", "match_id", "ord", set_similarity(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= threshold)
    best = pairs.groupBy("query_id").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", -F.col("ord"))).alias("m"))
    return best.select("query_id", "m.match_id", "m.score")
