"""Keyed state over event streams: greedy de-duplication and count triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import DEDUP_STATE_TTL_S, DEDUP_WINDOW_S, FORCE_EVENTS, RETENTION_DAYS, SUMMARIZE_AT_TURNS

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Greedy(StatefulProcessor):
    """Keeps a row iff no kept row of its key lies within the window before; the state moves on kept rows only."""

    def __init__(self, window_us: int, ttl_ms: int, columns: list[str]):
        self.window_us, self.ttl_ms, self.columns = window_us, ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        frame = pd.concat(frames).sort_values(["dedup_us", "dedup_order"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        keep, late = [], []
        for us in frame["dedup_us"].tolist():
            behind = last is not None and us < last
            kept = behind or last is None or us - last >= self.window_us
            if kept and not behind:
                last = us
            keep.append(kept)
            late.append(behind)
        self.last.update((last,))
        out = frame.assign(late=late)[keep]
        if len(out):
            yield out[[*self.columns, "late"]]

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, keys: list[str], time: str = "ts", row_id: str = "id", window_s: int = DEDUP_WINDOW_S, ttl_s: int = DEDUP_STATE_TTL_S) -> DataFrame:
    """Rows of a stream kept by the greedy rule, with ``late``.

    Rows of one micro-batch are sorted by time before they are judged. A row older than the last kept one of
    its key cannot be judged any more; it is passed on with ``late`` set, never dropped. State lives for
    ``ttl_s`` of processing time, longer than the window.
    """
    columns = events.columns
    schema = T.StructType([*events.schema.fields, T.StructField("late", T.BooleanType())])
    rows = events.withColumns({"dedup_key": F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256), "dedup_us": F.unix_micros(F.col(time).cast("timestamp")), "dedup_order": F.col(row_id).cast("string")})
    return rows.filter(F.col("dedup_us").isNotNull()).groupBy("dedup_key").transformWithStateInPandas(_Greedy(window_s * 1_000_000, ttl_s * 1000, columns), schema, "Append", "ProcessingTime")


class _Threshold(StatefulProcessor):
    """Counts turns of a session and fires at the threshold or on a control event."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n, forced = (self.count.get()[0] if self.count.exists() else 0), False
        for frame in rows:
            control = frame["event"].isin(FORCE_EVENTS)
            n, forced = n + int((~control).sum()), forced or bool(control.any())
        if n and (forced or n >= self.threshold):
            self.count.update((0,))
            yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "forced": [forced]})
        else:
            self.count.update((n,))

    def close(self) -> None:
        pass


def summary_triggers(turn_events: DataFrame, threshold: int = SUMMARIZE_AT_TURNS) -> DataFrame:
    """(session_id, turns, forced) whenever a session of a stream (session_id, event) is due for a summary."""
    return turn_events.filter(F.col("session_id").isNotNull()).groupBy("session_id").transformWithStateInPandas(_Threshold(threshold), "session_id string, turns long, forced boolean", "Append", "None")


def within_retention(events: DataFrame, time: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """A stream with a watermark of the retention, without rows older than it at arrival."""
    return events.withWatermark(time, f"{days} days").filter(F.col(time) >= F.current_timestamp() - F.make_interval(days=F.lit(days)))


def append_batches(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Write a stream to ``path`` by day; a batch that is run again replaces its own files, so rows count once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        days = batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id)})
        days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
