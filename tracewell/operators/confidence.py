"""Confidence that moves with hits and misses, and what it promotes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONFIDENCE_CAP, HIT_STEP, INITIAL_CONFIDENCE, MISS_STEP, PROMOTE_AT, RULES_LIMIT


def after(current: Column, hit: Column) -> Column:
    """Confidence after one hit or miss: capped above, not below; plain double steps, never a closed form."""
    return F.when(hit, F.least(current + F.lit(HIT_STEP), F.lit(CONFIDENCE_CAP))).otherwise(current - F.lit(MISS_STEP))


def fold_confidence(signals: DataFrame, keys: list[str], order: list[str], hit: str = "hit", start: float = INITIAL_CONFIDENCE) -> DataFrame:
    """(keys, hits, signals, confidence) after all signals of a key in order.

    The steps round, so their order and number matter and the fold is sequential. Rows are spread by key,
    sorted with spilling, and folded as a stream of Arrow batches: a key of any size needs three numbers of
    memory. A null signal is a miss; keys may be null.
    """
    kinds = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)
    rows = signals.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "_hit")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, hits, count, value = None, 0, 0, start
        types = None
        for batch in batches:
            types = types or [batch.column(i).type for i in range(len(keys))]
            done = []
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, is_hit in zip(*columns, strict=True):
                if key != unit:
                    if unit is not None:
                        done.append((*unit, hits, count, value))
                    unit, hits, count, value = key, 0, 0, start
                value = min(value + HIT_STEP, CONFIDENCE_CAP) if is_hit else value - MISS_STEP
                hits, count = hits + is_hit, count + 1
            if done:
                yield _batch(done, types, keys)
        if unit is not None:
            yield _batch([(*unit, hits, count, value)], types, keys)

    return ordered.mapInArrow(fold, f"{kinds}, hits long, signals long, confidence double")


def _batch(rows: list[tuple], types: list[pa.DataType], keys: list[str]) -> pa.RecordBatch:
    kinds = [*types, pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*keys, "hits", "signals", "confidence"])


def decayed(instincts: DataFrame, misses: Column) -> DataFrame:
    """Instincts with misses applied one by one; not part of any pipeline."""
    steps = F.when(misses > 0, F.sequence(F.lit(1), misses)).otherwise(F.array().cast("array<int>"))
    return instincts.withColumn("confidence", F.aggregate(steps, F.col("confidence"), lambda a, _: after(a, F.lit(False))))


def active(instincts: DataFrame) -> DataFrame:
    return instincts.filter(~F.coalesce("deprecated", F.lit(False)))


def promoted(instincts: DataFrame, limit: int = RULES_LIMIT, tie: list[str] | None = None) -> DataFrame:
    """Active instincts of high confidence, best first, then in order of their files; at most ``limit``."""
    ties = [F.asc(t) for t in tie] if tie else [F.asc(F.concat("id", F.lit(".md")))]
    return active(instincts).filter(F.col("confidence") >= PROMOTE_AT).orderBy(F.desc("confidence"), *ties).limit(limit)
