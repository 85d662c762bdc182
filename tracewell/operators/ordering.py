"""A dense global order of rows, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise


def globally_ordered(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """``columns`` and ``place``: 0, 1, 2 .. in the order of ``keys`` over all rows; stored.

    Rows are range-partitioned on all keys, so a group that shares the first ones is split as well. Only
    one number for each partition reaches the driver; it is broadcast again to shift the partitions' own
    numbering, which is why the ordered rows are stored before they are numbered densely.
    """
    placed = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns, F.monotonically_increasing_id().alias("place")), name)
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg((F.max(row) + 1).alias("n")).collect()
    starts, total = [], 0
    for p, n in sorted((r["part"], r["n"]) for r in sizes):
        starts.append((p, total))
        total += n
    shift = df.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.withColumn("part", part).join(F.broadcast(shift), "part").select(*columns, (row + F.col("start")).alias("place"))


CHUNK_ROWS = 50_000


def running_count(df: DataFrame, group: str, order: list[str], columns: list[str], flag: Column, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``columns``, ``place`` and ``running``: rows of the group so far, this one included, for which ``flag`` holds.

    A prefix sum in two levels, so that no group has to fit one task: windows run within chunks of the
    global order, and chunk totals - one row for each chunk and group in it - carry over.
    """
    ordered = globally_ordered(df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int")), [group, *order], [*columns, "_flag"], name)
    chunked = ordered.withColumn("_chunk", F.floor(F.col("place") / chunk_rows))
    inner = Window.partitionBy("_chunk", group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = chunked.groupBy("_chunk", group).agg(F.sum("_flag").alias("_total"))
    carried = totals.select("_chunk", group, F.coalesce(F.sum("_total").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = chunked.withColumn("_local", F.sum("_flag").over(inner))
    return local.join(carried, ["_chunk", group]).select(*columns, "place", (F.col("_local") + F.col("_before")).alias("running"))


def carried_forward(df: DataFrame, group: str, order: list[str], columns: list[str], carry: list[str], name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``columns`` with each of ``carry`` replaced by its last value in the group that is not null; in two levels, like ``running_count``."""
    ordered = globally_ordered(df, [group, *order], columns, name)
    chunked = ordered.withColumn("_chunk", F.floor(F.col("place") / chunk_rows))
    inner = Window.partitionBy("_chunk", group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = chunked.groupBy("_chunk", group).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(f"_{c}") for c in carry])
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_chunk", group, *[F.last(f"_{c}", ignorenulls=True).over(earlier).alias(f"_{c}") for c in carry])
    local = chunked.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in carry})
    rest = [c for c in columns if c not in carry]
    return local.join(carried, ["_chunk", group]).select(*rest, *[F.coalesce(c, f"_{c}").alias(c) for c in carry])


def with_previous(df: DataFrame, group: str, order: list[str], columns: list[str], lookback: int, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``columns`` and ``previous``: up to ``lookback`` rows of the group before this one, as structs of ``columns``, nearest first.

    The last rows of a chunk of the global order are repeated in the next one, and windows run in chunks.
    """
    ordered = globally_ordered(df, [group, *order], columns, name)
    chunk = F.floor(F.col("place") / chunk_rows)
    near_end = F.col("place") % chunk_rows >= chunk_rows - lookback
    doubled = ordered.withColumn("_chunk", F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy("_chunk").orderBy("place")
    row = F.struct(*columns)
    before = [F.when(F.lag(group, k).over(w) == F.col(group), F.lag(row, k).over(w)) for k in range(1, lookback + 1)]
    found = doubled.withColumn("previous", F.filter(F.array(*before), lambda x: x.isNotNull()))
    return found.filter(F.col("_chunk") == chunk).select(*columns, "previous")
