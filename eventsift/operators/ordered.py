"""Positions and running totals over a global order, without a task that holds a whole group.

Rows are range-partitioned by the full order, so even one key (or one key with one time) that
holds a third of the table spreads over many tasks. Totals of the earlier partitions of the
same key, a table of at most one row per key and partition, are then added to the local ones.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.storage import materialise

_MIN_TASK_ROWS = 10_000


def _range_count(df: DataFrame, rows: int, rows_per_task: int) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, rows), rows // max(rows_per_task, _MIN_TASK_ROWS) + 1)


def sorted_ranges(df: DataFrame, order: list[str], rows: int, rows_per_task: int) -> DataFrame:
    """``df`` with its range number ``_pid`` in the given order, stored once.

    Stored, because the range bounds come from sampling and may differ between two runs.
    """
    parts = _range_count(df, rows, rows_per_task)
    ranged = df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    return materialise(ranged, "ranges")


def running_totals(
    ranged: DataFrame, keys: list[str], order: list[str], weight: Column, carried: Column
) -> DataFrame:
    """Add ``total``, the sum of ``weight`` up to and including each row within its key, and
    ``before``, the largest ``carried`` of the rows ahead of it within its key.

    ``carried`` must not decrease along the order (nulls are skipped).
    """
    group = [*keys, "_pid"]
    ranged = ranged.withColumns({"_w": weight.cast("bigint"), "_c": carried})
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group)
        .agg(F.sum("_w").alias("_s"), F.max("_c").alias("_m"))
        .select(*group, F.sum("_s").over(earlier).alias("_off"), F.max("_m").over(earlier).alias("_prev"))
    )
    local = Window.partitionBy(*group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumns({"_t": F.sum("_w").over(upto), "_b": F.max("_c").over(ahead)})
        .join(offsets, group)
        .withColumn("total", F.col("_t") + F.coalesce("_off", F.lit(0)))
        .withColumn("before", F.coalesce("_b", "_prev"))
        .drop("_w", "_c", "_t", "_b", "_off", "_prev", "_pid")
    )


_ROW_BITS = 33  # of monotonically_increasing_id: row within a task below, the task above


def event_positions(
    events: DataFrame, order: list[str], name: str = "event_index", rows_per_task: int = 2_000_000
) -> DataFrame:
    """``events`` with the 0-based position of each row in ``order`` (a unique key).

    Rows are numbered inside their range where they are sorted, before they are stored; the sizes of the
    ranges ahead, one row per range, do the rest. So all rows move once.
    """
    parts = _range_count(events, events.count(), rows_per_task)
    ranged = events.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_pid", F.shiftright("_at", _ROW_BITS))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_pid").count().select("_pid", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_off"))
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ranged.join(F.broadcast(offsets), "_pid").withColumn(name, (row + F.col("_off")).cast("bigint")).drop("_pid", "_at", "_off")
