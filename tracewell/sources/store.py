"""Tables that are replaced whole: upserts, retention and single documents, for one writer.

A new version is written beside the old one and the pointer file is swapped by rename, so readers see
either version and a failed job leaves the old one.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEDUP_STATE_TTL_S


class VersionedTable:
    """A Parquet table at ``path`` with a current version."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        at = self._path(f"{self.path}/CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if self.fs.exists(at) else None

    def read(self) -> DataFrame:
        """The current rows; none before the first write."""
        version = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def overwrite(self, rows: DataFrame, keep: int = 2) -> None:
        """Replace all rows; the version before stays until ``keep`` newer ones exist."""
        version = f"v-{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/{version}")
        stream = self.fs.create(self._path(f"{self.path}/.CURRENT-{version}"), True)
        stream.write(bytearray(version.encode()))
        stream.close()
        self.fs.delete(self._path(f"{self.path}/CURRENT"), False)
        self.fs.rename(self._path(f"{self.path}/.CURRENT-{version}"), self._path(f"{self.path}/CURRENT"))
        old = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("v-"))
        for name in old[:-keep]:
            self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def upsert(self, rows: DataFrame, key: str) -> None:
        """Rows replace stored rows of the same key whole; of several the last by all columns."""
        self.overwrite(upserted(self.read(), rows.select(*self.schema.fieldNames()), key))


def upserted(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``store`` with ``rows`` in place of rows of the same key. Keys that are null are rows of their own."""
    rest = [c for c in rows.columns if c != key]
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
    fresh = one.unionByName(rows.filter(F.col(key).isNull()).select(key, *rest))
    return store.join(fresh.select(key), key, "left_anti").select(*store.columns).unionByName(fresh.select(*store.columns))


def live_state(state: DataFrame, now: dt.datetime, ttl_s: int = DEDUP_STATE_TTL_S) -> DataFrame:
    """De-duplication state (key, value) without entries past their time; entries that cannot be read stay."""
    at = F.try_to_timestamp("value")
    return state.filter(at.isNull() | (at >= F.lit(now) - F.make_interval(secs=F.lit(ttl_s))))


def write_document(text: DataFrame, path: str) -> None:
    """One text (a single-row table) as one file in ``path``."""
    text.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
