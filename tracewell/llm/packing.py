"""Filling windows of fixed capacity with documents (problem 8).

A window has three capacities: tokens, number of documents (a share of the tokens), and attention cost (the
sum of squared lengths, as documents in one window do not attend to each other; a share of the cost of one
document as long as the window). A document is cut only if it alone exceeds the token capacity: full pieces are
windows of their own, the rest is an item like any other document. A document whose cost alone exceeds the
attention capacity takes all of it, so nothing but empty documents shares its window. Items are placed by
vector best-fit: largest first, each into the open window that satisfies every constraint and has, after placing,
the least weighted norm of what is left (``score="norm"``), or the largest weighted dot product of item and
residual (``score="dot"``); otherwise into a new window.

Scale. Best-fit looks at all open windows, so it runs on groups of about ``items_per_group`` items: rows
are spread by a hash of a unique row number, which no repeated or null id can skew. A group leaves only a
few windows badly filled; a second round empties the windows filled below ``reopen_below`` and packs their
items again, in as many groups as they need. Nothing but counts reaches the driver; the windows' names and
capacities are a small parameter table.

Defined cases: null and empty texts have 0 tokens and still get a place; repeated rows are separate
documents; a null id stays null; ties are placed in order of row and piece; capacities that are null or
below 1 are ignored; no rows give no windows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise
from .tokenize import WORD_PATTERN

DEFAULT_RANKS = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


#: At most one document for so many tokens of capacity, and the attention capacity as a share of capacity squared.
DOCUMENTS_PER_TOKEN, ATTENTION_SHARE = 1 / 128, 0.9
#: What a unit of room left counts: mostly tokens; documents and attention decide between windows that are about as full.
WEIGHTS = (1.0, 0.05, 0.05)


def limits_of(capacity: int, documents_per_token: float = DOCUMENTS_PER_TOKEN, attention_share: float = ATTENTION_SHARE) -> tuple[int, int]:
    """(documents, attention cost) a window of this many tokens may have."""
    return max(1, int(capacity * documents_per_token)), max(1, int(capacity * capacity * attention_share))


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id_column, tokens): the number of tokens of each whole text, by a public tokenizer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=WORD_PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(x.as_py())) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_column, "tokens"])

    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("tokens", T.LongType())])
    return df.select(id_column, text_column).mapInArrow(count, schema)


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, max_attention: int, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> np.ndarray:
    """The window of each item; ``sizes`` in the order in which they are to be placed. ``weights``: of tokens, documents and attention left."""
    limits = np.array([capacity, max_documents, max_attention], np.int64)
    scale, weight = np.maximum(limits, 1).astype(float), np.array(weights)
    left = np.empty((len(sizes), 3), np.int64)
    window, opened = np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        item = np.array([size, 1, min(size * size, max_attention)], np.int64)
        rest = left[:opened] - item
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            if score == "norm":
                chosen = fits[np.argmin(((rest[fits] / scale) ** 2) @ weight)]
            else:
                chosen = fits[np.argmax((left[fits] / scale) @ (weight * item / scale))]
        else:
            chosen, opened = opened, opened + 1
            left[chosen] = limits
        left[chosen] -= item
        window[i] = chosen
    return window


def pack(sizes: DataFrame, windows: list[tuple[str, int]], id_column: str = "doc_id", items_per_group: int = 4000, reopen_below: float = 0.97, documents_per_token: float = DOCUMENTS_PER_TOKEN, attention_share: float = ATTENTION_SHARE, score: str = "norm") -> DataFrame:
    """(window_name, window_id, id_column, piece, first_token, tokens) of every document or piece."""
    sizes = materialise(sizes.select(id_column, "tokens", F.monotonically_increasing_id().alias("row")), "sizes")
    id_type = sizes.schema[id_column].dataType
    windows = [(n, int(c)) for n, c in windows if n is not None and c is not None and c >= 1]
    out = T.StructType([T.StructField("window_name", T.StringType()), T.StructField("window_id", T.StringType()), T.StructField(id_column, id_type), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("tokens", T.LongType())])
    if not windows:
        return sizes.sparkSession.createDataFrame([], out)
    kinds = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in windows])
    pieces = sizes.select("*", F.explode(kinds).alias("w")).select(id_column, "row", "w.*", F.col("tokens").alias("whole"))
    last = F.greatest(F.ceil(F.col("whole") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    pieces = pieces.select("*", F.posexplode(F.sequence(F.lit(0), last)).alias("piece", "_")).withColumn("first_token", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity"), F.col("whole") - F.col("first_token"))).drop("_", "whole")
    alone = pieces.filter(F.col("tokens") == F.col("capacity")).withColumn("window_id", F.concat_ws("-", "window_name", F.lit("full"), "row", "piece"))
    items = pieces.filter(F.col("tokens") < F.col("capacity"))
    columns = out.fieldNames()
    grouped_schema = T.StructType([*out.fields, T.StructField("row", T.LongType()), T.StructField("capacity", T.LongType())])

    def packed(rows: DataFrame, round_no: int) -> DataFrame:
        counts = {r["window_name"]: r["n"] for r in rows.groupBy("window_name").agg(F.count("*").alias("n")).collect()}
        groups = F.lit(1)
        for name, n in counts.items():
            groups = F.when(F.col("window_name") == name, F.lit(max(1, -(-n // items_per_group)))).otherwise(groups)
        spread = rows.withColumn("group", F.pmod(F.xxhash64("row", "piece", F.lit(round_no)), groups))

        def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
            capacity = int(frame["capacity"].iloc[0])
            window = best_fit(frame["tokens"].to_numpy(np.int64), capacity, *limits_of(capacity, documents_per_token, attention_share), score=score)
            return frame.assign(window_id=[f"{key[0]}-{round_no}-{key[1]}-{w}" for w in window])[grouped_schema.fieldNames()]

        return materialise(spread.groupBy("window_name", "group").applyInPandas(place, grouped_schema), "packed")

    first = packed(items, 1)
    filled = first.groupBy("window_id").agg(F.sum("tokens").alias("filled"), F.max("capacity").alias("c"))
    poor = filled.filter(F.col("filled") < reopen_below * F.col("c")).select("window_id")
    again = packed(first.join(poor, "window_id", "left_semi").drop("window_id"), 2)
    return alone.select(columns).unionByName(first.join(poor, "window_id", "left_anti").select(columns)).unionByName(again.select(columns))


def window_report(placed: DataFrame, windows: list[tuple[str, int]], id_column: str = "doc_id") -> DataFrame:
    """(window_name, documents, windows, fill, at_documents, at_attention, over, cut_needlessly, torn): the result of ``pack`` held against every constraint.

    ``at_documents`` and ``at_attention`` are shares of windows that have no room left for another document, or
    for one as long as the tokens left would take; ``over`` windows break a capacity, ``cut_needlessly``
    documents are divided though they fit, ``torn`` ones have gaps between their pieces. For unique ids.
    """
    sides = placed.sparkSession.createDataFrame([(n, int(c), *limits_of(int(c))) for n, c in windows if n is not None and c is not None and c >= 1], "window_name string, capacity long, max_documents int, max_attention long")
    size = F.least(F.col("tokens") * F.col("tokens"), F.col("max_attention"))
    rows = placed.join(F.broadcast(sides), "window_name")
    filled = rows.groupBy("window_name", "window_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.sum(size).alias("cost"), F.first("capacity").alias("capacity"), F.first("max_documents").alias("max_documents"), F.first("max_attention").alias("max_attention"))
    room = F.col("capacity") - F.col("tokens")
    by_window = filled.groupBy("window_name").agg(
        F.count("*").alias("windows"), (F.sum("tokens") / F.sum("capacity")).alias("fill"), F.avg((F.col("n") >= F.col("max_documents")).cast("int")).alias("at_documents"),
        F.avg(((room > 0) & (F.col("cost") + room * room > F.col("max_attention"))).cast("int")).alias("at_attention"),
        F.count_if((F.col("tokens") > F.col("capacity")) | (F.col("n") > F.col("max_documents")) | (F.col("cost") > F.col("max_attention"))).alias("over"),
    )
    whole = rows.groupBy("window_name", id_column).agg(F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.min("first_token").alias("start"), F.count("*").alias("n"), F.first("capacity").alias("capacity"))
    by_document = whole.groupBy("window_name").agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_needlessly"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("start") != 0)).alias("torn"))
    return by_window.join(by_document, "window_name").select("window_name", "documents", "windows", "fill", "at_documents", "at_attention", "over", "cut_needlessly", "torn")
