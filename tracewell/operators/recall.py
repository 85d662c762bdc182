"""Retrieval: TF-IDF and vector neighbours, and the cache of embeddings they need."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.vectors import cosine, l2
from ..runtime import big_join, materialise
from ..schemas import RECALL_K

TERM = r"[\p{L}\p{N}_]{2,}"
SALTS = 8
BLOCK_ROWS = 1000


def terms(c: str | Column) -> Column:
    """Lower-case runs of at least two word characters; a run of a script without spaces is one term."""
    text = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


class TfidfIndex:
    """Stored postings, document frequencies and lengths of documents (id, text) for TF-IDF questions.

    idf = ln((1 + n) / (1 + df)) + 1 over the documents and the question; raw counts; L2 norms. Lengths are stored
    for the frequencies without the question; a question changes those of its own terms alone, so it reads the
    postings of its terms - a range of files sorted by term - and corrects the lengths from them. Postings of a
    frequent term are salted where they meet their weight while the index is built.
    """

    def __init__(self, documents: DataFrame):
        self.spark = documents.sparkSession
        tokens = documents.select("id", F.explode(terms("text")).alias("term"))
        counts = tokens.groupBy("id", "term").agg(F.count("*").alias("tf"))
        self.postings = materialise(counts.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")
        self.frequencies = materialise(self.postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        self.n = documents.count() + 1
        idf = F.log((1 + F.lit(self.n)) / (1 + F.col("df"))) + 1
        salted = self.frequencies.select("term", idf.alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        weighted = big_join(self.postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), salted, ["term", "salt"])
        sizes = weighted.groupBy("id").agg(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2))).alias("sq"))
        self.lengths = materialise(big_join(documents.select("id").distinct(), sizes, "id", "left").select("id", F.coalesce("sq", F.lit(0.0)).alias("sq")), "lengths")

    def matching(self, query: str) -> DataFrame:
        """(id, score) of the documents that have a term of the question; only the question's own terms reach the driver."""
        asked = {r["term"]: r["n"] for r in self.spark.range(1).select(F.explode(terms(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        if not asked:
            return self.lengths.limit(0).select("id", F.lit(0.0).alias("score"))
        known = {r["term"]: r["df"] for r in self.frequencies.filter(F.col("term").isin(list(asked))).collect()}
        idf = lambda df: math.log((1 + self.n) / (1 + df)) + 1
        rows = [(t, idf(known.get(t, 0)), idf(known.get(t, 0) + 1), n) for t, n in asked.items()]
        length = math.sqrt(sum((n * w) ** 2 for _, _, w, n in rows))
        weights = self.spark.createDataFrame(rows, "term string, before double, now double, qtf long")
        met = self.postings.filter(F.col("term").isin(list(asked))).join(F.broadcast(weights), "term")
        tf, before, now = F.col("tf"), F.col("before"), F.col("now")
        sums = met.groupBy("id").agg(F.sum(tf * now * F.col("qtf") * now).alias("dot"), F.sum(tf * tf * (now * now - before * before)).alias("more"))
        return big_join(sums, self.lengths, "id").select("id", (F.col("dot") / (F.lit(length) * F.sqrt(F.col("sq") + F.col("more")))).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """(id, score) of every document; 0 where no term is shared."""
        return big_join(self.lengths.select("id"), self.matching(query), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def top(self, query: str, k: int = RECALL_K, digits: int = 9) -> DataFrame:
        """The ``k`` best documents (id, score, rank); equal scores in order of id. Documents without a shared term fill up what is missing."""
        best = materialise(self.matching(query).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "id").limit(k), "best")
        rest = big_join(self.lengths.select("id"), best.select("id"), "id", "left_anti").orderBy("id").limit(k).withColumn("score", F.lit(0.0))
        found = best if best.count() >= k else best.unionByName(rest).orderBy(F.desc("score"), "id").limit(k)
        return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def tfidf_scores(documents: DataFrame, query: str) -> DataFrame:
    """(id, score): cosine of every document (id, text) and the query; for several questions keep the ``TfidfIndex``."""
    return TfidfIndex(documents).scores(query)


def recall_tfidf(documents: DataFrame, query: str, k: int = RECALL_K, digits: int = 9) -> DataFrame:
    """The ``k`` best documents (id, score, rank); equal scores in order of id."""
    return TfidfIndex(documents).top(query, k, digits)


def nearest(candidates: DataFrame, vector: list[float], k: int = RECALL_K, metric: str = "cosine") -> DataFrame:
    """The ``k`` candidates (id, embedding) nearest to one vector; vectors of another length are left out."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = candidates.filter(F.size("embedding") == len(vector))
    score = cosine(F.col("embedding"), q) if metric == "cosine" else l2(F.col("embedding"), q)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), "id").limit(k)


def knn(queries: DataFrame, candidates: DataFrame, k: int = RECALL_K, metric: str = "l2", digits: int = 6) -> DataFrame:
    """(query_id, id, rank, score): the exact ``k`` nearest candidates of each query.

    queries (query_id, embedding) is a stated set, taken in blocks that are broadcast; every partition of the
    candidates (id, embedding) keeps its own ``k`` best by matrix product in double precision, and these few
    rows are ranked. Null vectors and vectors of another length than the block's first are left out.
    """
    spark = queries.sparkSession
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), candidates.schema["id"].dataType.simpleString()
    stored = materialise(queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding", F.monotonically_increasing_id().alias("n")), "knn")
    blocks = max(1, -(-stored.count() // BLOCK_ROWS))
    found = None
    for b in range(blocks):
        rows = stored.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).select("query_id", "embedding").collect()
        if not rows:
            continue
        width = len(rows[0]["embedding"])
        rows = [r for r in rows if len(r["embedding"]) == width]
        block = spark.sparkContext.broadcast(np.array([r["embedding"] for r in rows], np.float64))

        def search(batches: Iterator[pa.RecordBatch], block=block, width=width) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            q = block.value
            q_norm = np.sqrt((q * q).sum(1))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    vectors = part.column(1).to_pylist()
                    fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
                    if not fits:
                        continue
                    c = np.array([vectors[i] for i in fits], np.float64)
                    product = q @ c.T
                    if metric == "cosine":
                        size = q_norm[:, None] * np.sqrt((c * c).sum(1))[None]
                        score = -np.divide(product, size, out=np.zeros_like(product), where=size > 0)
                    else:
                        score = np.sqrt(np.maximum(((q * q).sum(1))[:, None] + ((c * c).sum(1))[None] - 2 * product, 0))
                    score = np.round(score, digits)
                    few = min(k, len(fits))
                    edge = np.partition(score, few - 1, axis=1)[:, few - 1 : few]
                    row, col = np.nonzero(score <= edge)  # ties at the edge stay until the ids decide
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), part.column(0).take(pa.array(np.array(fits)[col])), pa.array(score[row, col])], names=["q", "id", "score"])

        ids = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"q long, query_id {q_type}")
        near = candidates.select("id", "embedding").mapInArrow(search, f"q long, id {c_type}, score double")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).filter(F.col("rank") <= k)
        part = ranked.join(F.broadcast(ids), "q").select("query_id", "id", "rank", (-F.col("score") if metric == "cosine" else F.col("score")).alias("score"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"query_id {q_type}, id {c_type}, rank int, score double")


def cache_misses(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(memory_id, text, content_hash, embedding): items (memory_id, text) whose text has no vector of this model; the vector is the outdated one, if any."""
    fresh = items.withColumn("content_hash", content_hash(F.coalesce("text", F.lit(""))))
    known = cache.filter(F.col("model") == model).select("memory_id", F.col("content_hash").alias("known"), "embedding")
    return fresh.join(known, "memory_id", "left").filter(F.col("known").isNull() | (F.col("known") != F.col("content_hash"))).drop("known")


def sync_vectors(items: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], model: str, batch: int = 64) -> DataFrame:
    """The cache (memory_id, model, content_hash, embedding, stale) brought up to date with ``items``.

    Only texts that are new or changed are embedded, in batches inside the partitions. An item that fails has
    no vector, or keeps its outdated one, marked ``stale``. Vectors of items that are gone are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made: list = []
            texts = frame["text"].fillna("").tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    made += embed(part)
                except Exception:  # noqa: BLE001 - one bad text must not cost the others
                    for text in part:
                        try:
                            made += embed([text])
                        except Exception:  # noqa: BLE001
                            made.append(None)
            old = frame["embedding"].tolist()
            stale = [m is None for m in made]
            yield pd.DataFrame({"memory_id": frame["memory_id"], "content_hash": frame["content_hash"], "embedding": [o if m is None else m for m, o in zip(made, old, strict=True)], "stale": stale})

    made = cache_misses(items, cache, model).mapInPandas(run, "memory_id string, content_hash string, embedding array<float>, stale boolean").filter(F.col("embedding").isNotNull())
    current = items.select("memory_id", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    kept = cache.filter(F.col("model") == model).select("memory_id", "content_hash", "embedding").join(current, ["memory_id", "content_hash"], "left_semi").withColumn("stale", F.lit(False))
    return kept.unionByName(made).select("memory_id", F.lit(model).alias("model"), "content_hash", "embedding", "stale")


def live_only(vectors: DataFrame, live: DataFrame, key: str = "memory_id") -> DataFrame:
    """Vectors of rows that still exist - before the nearest are taken, so that dead ones cannot crowd them out."""
    return vectors.join(live.select(key).distinct(), key, "left_semi")


def rehydrated(ranked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Full rows of ranked ids, with their rank."""
    return ranked.select(key, "rank").join(rows, key).orderBy("rank")


def recall_top_k(memories: DataFrame, query: str, provider: object, k: int = RECALL_K, cache: DataFrame | None = None) -> DataFrame:
    """The ``k`` memories for a query, with ``rank``: by cached vectors if the provider's space is stable, else by TF-IDF.

    memories has (id, body, keywords, ..). A provider that fails gives no rows.
    """
    from ..functions.text import cacheable_text

    text = cacheable_text("body", "keywords")
    if not getattr(provider, "supports_cache", False):
        top = recall_tfidf(memories.select("id", text.alias("text")), query, k)
        return rehydrated(top, memories)
    try:
        vector = provider.embed([query])[0]
    except Exception:  # noqa: BLE001
        return memories.withColumn("rank", F.lit(None).cast("int")).limit(0)
    spark = memories.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], "memory_id string, model string, content_hash string, embedding array<float>")
    items = memories.filter(F.col("id").isNotNull()).select(F.col("id").alias("memory_id"), text.alias("text"))
    vectors = sync_vectors(items, cache, provider.embed, provider.name)
    top = nearest(vectors.select(F.col("memory_id").alias("id"), "embedding"), vector, k, metric="l2")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))
    return rehydrated(ranked, memories)
