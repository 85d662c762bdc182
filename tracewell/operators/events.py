"""Observations: cleaning, windowed de-duplication, retention and keyed scans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import big_join, materialise
from ..schemas import DEDUP_STATE_TTL_S, DEDUP_WINDOW_S, RETENTION_DAYS


def with_input(df: DataFrame, column: str = "tool_input_json") -> DataFrame:
    """``df`` with ``tool_input`` as VARIANT; null and malformed input is an empty object."""
    return df.withColumn("tool_input", F.coalesce(F.try_parse_json(column), F.parse_json(F.lit("{}"))))


def new_observations(df: DataFrame, session: str | None = None, after_id: int = 0) -> DataFrame:
    """Rows of one session (of all, if None) past a cursor, by id."""
    rows = df.filter(F.col("id") > after_id)
    return (rows.filter(F.col("session_id") == session) if session is not None else rows).orderBy("id")


def observations_between(df: DataFrame, start: Column, end: Column | None = None, session: str | None = None) -> DataFrame:
    """Rows with start <= ts < end, by id; no end is unbounded."""
    rows = df.filter(F.col("ts") >= start)
    rows = rows if end is None else rows.filter(F.col("ts") < end)
    return (rows.filter(F.col("session_id") == session) if session is not None else rows).orderBy("id")


def retained(df: DataFrame, now: Column, days: int = RETENTION_DAYS, time: str = "ts") -> DataFrame:
    """Rows not older than the retention; a row without time is dropped."""
    return df.filter(F.col(time) >= now - F.make_interval(days=F.lit(days)))


def dedup_windowed(df: DataFrame, keys: list[str], time: str = "ts", row_id: str = "id", window_s: int = DEDUP_WINDOW_S, state: DataFrame | None = None) -> DataFrame:
    """Rows kept by the greedy rule: kept iff no kept row of the same keys lies less than ``window_s`` before.

    The state moves on kept rows only, so this is a fold in order of (time, id) and not a comparison with the
    previous row. A gap of ``window_s`` restarts it, and an empty slot of that length between two others is
    such a gap. Keys are first reduced to their slots (pre-aggregated before the shuffle, bounded by the time
    span); neighbouring slots form a run, and a run is the unit of work: rows are spread by run, sorted, and
    folded as a stream of Arrow batches with one number of state. Nulls in keys are a key like others; rows
    without time are all kept. ``state`` (``dedup_state``) has the last row kept of each key in earlier batches;
    it takes part at its time like a row that is kept.
    """
    step = window_s * 1_000_000
    timed = _keyed(df, keys, time).select("_key", "_us", F.col(row_id).alias("row_id"), F.lit(False).alias("_old"))
    if state is not None:
        timed = timed.unionByName(state.select(F.col("key").alias("_key"), F.col("last_us").alias("_us"), F.lit(None).cast(df.schema[row_id].dataType).alias("row_id"), F.lit(True).alias("_old")))
    timed = timed.withColumn("_slot", F.floor(F.col("_us") / step))
    slots = timed.select("_key", "_slot").distinct()
    w = Window.partitionBy("_key").orderBy("_slot")
    begins = F.coalesce(F.col("_slot") - F.lag("_slot").over(w) > 1, F.lit(True))
    runs = slots.withColumn("_begin", F.when(begins, F.col("_slot"))).withColumn("_run", F.max("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("_key", "_slot", "_run")
    placed = big_join(timed, runs, ["_key", "_slot"])
    ordered = placed.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us", F.desc("_old"), "row_id").select("_key", "_run", "_us", "row_id", "_old")
    id_type = df.schema[row_id].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, last = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (key, run, at, old) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)):
                if (key, run) != unit:
                    unit, last, keep[i] = (key, run), at, not old
                elif old or at - last >= step:
                    last, keep[i] = at, not old
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(keep))], names=["row_id"])

    kept = ordered.mapInArrow(fold, f"row_id {id_type}")
    return big_join(df.filter(F.col(time).isNotNull()), kept.withColumnRenamed("row_id", row_id), row_id, "left_semi").unionByName(df.filter(F.col(time).isNull()))


def _keyed(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows that have a time, with ``_key``, a hash of the keys, and ``_us``."""
    key = F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}), 256)
    return df.filter(F.col(time).isNotNull()).withColumns({"_key": key, "_us": F.unix_micros(F.col(time).cast("timestamp"))})


def dedup_state(kept: DataFrame, keys: list[str], time: str = "ts", before: DataFrame | None = None, ttl_s: int = DEDUP_STATE_TTL_S) -> DataFrame:
    """(key, last_us): the state after a batch, from its kept rows and the state ``before``; entries older than ``ttl_s`` before the newest go.

    A row that arrives later than that is judged without them, as where state expires.
    """
    last = _keyed(kept, keys, time).groupBy(F.col("_key").alias("key")).agg(F.max("_us").alias("last_us"))
    if before is not None:
        last = last.unionByName(before.select("key", "last_us")).groupBy("key").agg(F.max("last_us").alias("last_us"))
    last = materialise(last, "dedup_state")
    newest = last.agg(F.max("last_us")).first()[0]
    return last if newest is None else last.filter(F.col("last_us") >= newest - ttl_s * 1_000_000)


def appended(store: DataFrame, rows: DataFrame, now: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """The store with new rows, without any that are past retention - a row that arrives too late included."""
    return retained(store.unionByName(rows), F.lit(now), days)
