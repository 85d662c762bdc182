"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

The plan is map-only: no shuffle, no driver work. Every partition splits its texts into words, keeps
each distinct word once, and contracts these words with a DuckDB recursive query in which
token-position rows join the merge table. What a text costs is therefore its length once, plus the
contraction of the words not yet seen in that partition.

Two queries share the work. Both contract, in every step, each word's pair of least rank, leftmost
first, until no pair of the word is in the merge table:

* short words: one contraction a step (``_LEFTMOST``);
* long words (``long_word_bytes``): all occurrences of the least pair in one step (``_ALL_OCCURRENCES``),
  which gives the same tokens - a contraction of rank r only makes pairs of higher rank, so the
  remaining occurrences of r come next anyway; occurrences that overlap (``aaa``) are taken by turns
  from the left. Without it a run of n letters would take n steps of n rows.

Defined cases: null, empty texts give an empty list; every other string, blank ones included, gives the
tokens of its characters. Strings that look like special tokens are ordinary text. Rows are neither
dropped nor merged: repeated ``doc_id``s stay, a null ``doc_id`` stays null. Lone surrogates cannot occur,
as Spark strings are UTF-8.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the published split pattern of this vocabulary family.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")

_LEFTMOST = """
WITH RECURSIVE contract(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM seed
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN pos = best_left THEN best_tok ELSE tok END
  FROM (
    SELECT step, word, pos, tok, key, min(key) OVER (PARTITION BY word) AS best,
           min(key) OVER (PARTITION BY word) & 4294967295 AS best_left,
           min(key) OVER (PARTITION BY word) >> 32 AS best_tok
    FROM (
      SELECT c.step, c.word, c.pos, c.tok, (m.merged << 32) | c.left_pos AS key
      FROM (SELECT *, lag(tok) OVER w AS left_tok, lag(pos) OVER w AS left_pos
            FROM contract WINDOW w AS (PARTITION BY word ORDER BY pos)) c
      LEFT JOIN merges m ON m.l = c.left_tok AND m.r = c.tok))
  WHERE best IS NOT NULL AND key IS DISTINCT FROM best
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT * FROM contract QUALIFY step = max(step) OVER (PARTITION BY word))
GROUP BY word
"""

_ALL_OCCURRENCES = """
WITH RECURSIVE contract(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM seed
  UNION ALL
  SELECT step + 1, word, pos, CASE WHEN right_is_hit THEN best ELSE tok END
  FROM (
    SELECT *, coalesce(lead(hit) OVER (PARTITION BY word ORDER BY pos), false) AS right_is_hit
    FROM (
      SELECT *, candidate AND row_number() OVER (PARTITION BY word, candidate, island ORDER BY pos) % 2 = 1 AS hit
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos)
                  - row_number() OVER (PARTITION BY word, candidate ORDER BY pos) AS island
        FROM (
          SELECT *, coalesce(merged = best, false) AS candidate
          FROM (
            SELECT c.step, c.word, c.pos, c.tok, m.merged, min(m.merged) OVER (PARTITION BY c.word) AS best
            FROM (SELECT *, lag(tok) OVER (PARTITION BY word ORDER BY pos) AS left_tok FROM contract) c
            LEFT JOIN merges m ON m.l = c.left_tok AND m.r = c.tok)
          WHERE best IS NOT NULL))))
  WHERE NOT hit
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT * FROM contract QUALIFY step = max(step) OVER (PARTITION BY word))
GROUP BY word
"""


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordContractor:
    """Token ids of words, by DuckDB; remembers the words it has seen."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, long_word_bytes: int = 48, slice_bytes: int = 400_000, remembered: int = 600_000, memory_mb: int = 256):
        import duckdb

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = [ids[s] for s in _byte_symbols()]
        self.long_word_bytes, self.slice_bytes, self.remembered = long_word_bytes, slice_bytes, remembered
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": f"{memory_mb}MB"})
        ranked = [ids[a + b] for a, b in merges]
        if any(a >= b for a, b in zip(ranked, ranked[1:], strict=False)):
            raise ValueError("ids of merged tokens must rise with the rank of the merge, as rank and token are one number here")
        arrow = pa.table({"l": pa.array([ids[a] for a, _ in merges], pa.int64()), "r": pa.array([ids[b] for _, b in merges], pa.int64()), "merged": pa.array(ranked, pa.int64())})
        self.db.register("merges_arrow", arrow)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_arrow")
        self.ids_of: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Contract the given distinct words, in slices of like length that bound the rows of a query."""
        encoded = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        begin = 0
        while begin < len(encoded):
            is_long, size, end = len(encoded[begin][0]) > self.long_word_bytes, 0, begin
            while end < len(encoded) and (end == begin or size < self.slice_bytes) and (len(encoded[end][0]) > self.long_word_bytes) == is_long:
                size += len(encoded[end][0])
                end += 1
            part = encoded[begin:end]
            rows = [(i, p, self.byte_ids[b]) for i, (raw, _) in enumerate(part) for p, b in enumerate(raw)]
            w, p, t = zip(*rows, strict=True)
            self.db.register("seed", pa.table({"word": pa.array(w, pa.int64()), "pos": pa.array(p, pa.int64()), "tok": pa.array(t, pa.int64())}))
            for i, found in self.db.execute(_ALL_OCCURRENCES if is_long else _LEFTMOST).fetchall():
                self.ids_of[part[i][1]] = found
            self.db.unregister("seed")
            begin = end

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Offsets and ids of all texts, as one flat list."""
        import regex

        pattern = regex.compile(WORD_PATTERN)
        if len(self.ids_of) > self.remembered:
            self.ids_of.clear()
        fresh: dict[str, None] = {}
        for text in texts:
            for word in pattern.findall(text) if text else ():
                if word not in self.ids_of:
                    fresh[word] = None
        self.learn(list(fresh))
        offsets, flat, ids_of = [0], [], self.ids_of
        for text in texts:
            for word in pattern.findall(text) if text else ():
                flat += ids_of[word]
            offsets.append(len(flat))
        return offsets, flat


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY, texts_at_once: int = 1000) -> DataFrame:
    """``(id_column, ids)`` for every row of ``df``; see the module for the defined cases."""
    kind = df.schema[id_column].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contractor = None
        for batch in batches:
            contractor = contractor or WordContractor(vocabulary)
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                offsets, flat = contractor.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_column, text_column).mapInArrow(encode, schema)


def decode_corpus(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, rows_at_once: int = 1000) -> DataFrame:
    """``(id_column, text)``: the text whose tokens ``ids_column`` lists; null and empty lists give an empty text.

    Token-position rows join the vocabulary, and an ordered aggregation puts the stand-ins of the bytes together.
    """
    kind = df.schema[id_column].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with open(vocabulary, encoding="utf-8") as f:
            symbols = {i: s for s, i in json.load(f)["model"]["vocab"].items()}
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        db = duckdb.connect(config={"threads": "1"})
        arrow = pa.table({"tok": pa.array(list(symbols), pa.int32()), "symbol": pa.array(list(symbols.values()))})
        db.register("symbols_arrow", arrow)
        db.execute("CREATE TABLE symbols AS SELECT * FROM symbols_arrow")
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                lists = part.column(1).to_pylist()
                rows = [(i, p, t) for i, ids in enumerate(lists) for p, t in enumerate(ids or ())]
                texts = [""] * len(lists)
                if rows:
                    doc, pos, tok = zip(*rows, strict=True)
                    db.register("placed", pa.table({"doc": pa.array(doc, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))
                    for i, written in db.execute("SELECT doc, string_agg(symbol, '' ORDER BY pos) FROM placed JOIN symbols USING (tok) GROUP BY doc").fetchall():
                        texts[i] = bytes(byte_of[c] for c in written).decode("utf-8", "replace")
                    db.unregister("placed")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    schema = T.StructType([T.StructField(id_column, kind), T.StructField("text", T.StringType())])
    return df.select(id_column, ids_column).mapInArrow(decode, schema)
