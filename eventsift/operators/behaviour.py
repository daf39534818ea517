"""Gap to the previous event and trailing event count, per source.

A source may hold a third of all rows, so windows never run over a whole source. Rows are
grouped by (source, time slot). A slot also gets the tail of the slot before it, as far as the
trailing window reaches, and one marker row with the last earlier time of its source, so every
answer is found inside the group. Slots that are still too big (a flood, or many equal times)
are answered from running totals over range-partitioned rows instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.functions.times import micros
from eventsift.operators.ordered import running_totals, sorted_ranges
from eventsift.schema import ROLLING_WINDOW_SECONDS
from eventsift.storage import materialise

_HOUR = 3_600_000_000
_EVENT, _TAIL, _MARKER, _QUERY = 0, 1, 2, 3
# Rows without a source or a time have no neighbours; they only need to be spread evenly.
_SPREAD = 4096


def source_windows(
    events: DataFrame,
    window_seconds: int = ROLLING_WINDOW_SECONDS,
    max_group_rows: int = 2_000_000,
    gap: str = "gap_seconds",
    count: str = "trailing_count",
) -> DataFrame:
    """Add ``gap`` (seconds to the previous event of the source; null for its first event and
    for rows without a source or time) and ``count`` (events of the source in
    ``(t - window, t]``, in row order among equal times; 0 without a source or time).

    Equal times are ordered by ``event_id``, which must be unique.
    """
    reach = window_seconds * 1_000_000
    width = max(_HOUR, reach)
    us = micros(F.col("timestamp"))
    timed = events.withColumns({"_us": us, "_ok": F.col("source").isNotNull() & F.col("timestamp").isNotNull()})
    into = F.pmod("_us", F.lit(width))
    slot = F.expr(f"(_us - pmod(_us, {width}L)) div {width}L")
    timed = timed.withColumns({"_slot": slot, "_tail": into > width - reach})

    slots = _slot_sizes(timed)
    hot = slots.filter(F.col("n") + F.col("n_tail_before") > max_group_rows).select("source", "_slot")
    markers = slots.filter("last_before is not null").select(
        "source", "_slot", F.col("last_before").alias("_us"), F.lit(_MARKER).alias("_kind")
    )
    tails = timed.filter("_ok and _tail").select(
        "source", (F.col("_slot") + 1).alias("_slot"), "_us", "event_id", F.lit(_TAIL).alias("_kind")
    )
    own = timed.withColumns(
        {
            "_kind": F.lit(_EVENT),
            "_key": F.when(F.col("_ok"), F.col("source")),
            "_part": F.when(F.col("_ok"), F.col("_slot")).otherwise(F.pmod(F.hash("event_id"), F.lit(_SPREAD))),
        }
    ).drop("_slot", "_tail")
    if hot.isEmpty():
        return _within_slots(own, tails, markers, reach, gap, count)

    hot = materialise(hot, "hot-slots")
    cold_slots = slots.join(hot, ["source", "_slot"], "left_anti").select("source", "_slot")
    in_hot = hot.withColumnRenamed("source", "_key").withColumnRenamed("_slot", "_part")
    calm = _within_slots(
        own.join(in_hot, ["_key", "_part"], "left_anti"),
        tails.join(cold_slots, ["source", "_slot"], "left_semi"),
        markers.join(cold_slots, ["source", "_slot"], "left_semi"),
        reach,
        gap,
        count,
    )
    answers = _by_running_totals(
        timed.filter("_ok"), tails, markers, hot, slots, width, reach, max_group_rows, gap, count
    )
    flood = own.join(in_hot, ["_key", "_part"], "left_semi").select(*events.columns).join(answers, "event_id")
    return calm.unionByName(flood.select(*calm.columns))


def _slot_sizes(timed: DataFrame) -> DataFrame:
    """Per (source, slot): rows, tail rows of the slot before, last time of any earlier slot."""
    sizes = (
        timed.filter("_ok")
        .groupBy("source", "_slot")
        .agg(F.count("*").alias("n"), F.count_if("_tail").alias("n_tail"), F.max("_us").alias("last_us"))
    )
    # Slots of one source: at most one row per hour of its history.
    by_time = Window.partitionBy("source").orderBy("_slot")
    adjacent = F.lag("_slot").over(by_time) == F.col("_slot") - 1
    return materialise(
        sizes.select(
            "source",
            "_slot",
            "n",
            F.when(adjacent, F.lag("n_tail").over(by_time)).otherwise(0).alias("n_tail_before"),
            F.lag("last_us").over(by_time).alias("last_before"),
        ),
        "slots",
    )


def _gap(us: Column, previous: Column) -> Column:
    return (us - previous) / 1_000_000


def _within_slots(
    own: DataFrame, tails: DataFrame, markers: DataFrame, reach: int, gap: str, count: str
) -> DataFrame:
    """One shuffle and one sort on (source, slot): both frames only grow, so a row costs O(1)."""
    helpers = tails.unionByName(markers, allowMissingColumns=True).withColumnsRenamed(
        {"source": "_key", "_slot": "_part"}
    )
    stacked = own.unionByName(helpers, allowMissingColumns=True)
    group = Window.partitionBy("_key", "_part")
    row_order = group.orderBy("_us", "event_id")
    is_event = (F.col("_kind") != _MARKER).cast("int")
    upto = F.sum(is_event).over(row_order.rowsBetween(Window.unboundedPreceding, 0))
    expired = F.sum(is_event).over(group.orderBy("_us").rangeBetween(Window.unboundedPreceding, -reach))
    ok = F.col("_ok")
    return (
        stacked.withColumns({"_upto": upto, "_prev": F.lag("_us").over(row_order), "_old": expired})
        .filter(F.col("_kind") == _EVENT)
        .withColumns(
            {
                gap: F.when(ok, _gap(F.col("_us"), F.col("_prev"))),
                count: F.when(ok, F.col("_upto") - F.coalesce("_old", F.lit(0))).otherwise(0).cast("double"),
            }
        )
        .drop("_us", "_ok", "_kind", "_key", "_part", "_upto", "_prev", "_old")
    )


def _by_running_totals(
    timed: DataFrame,
    tails: DataFrame,
    markers: DataFrame,
    hot: DataFrame,
    slots: DataFrame,
    width: int,
    reach: int,
    rows_per_task: int,
    gap: str,
    count: str,
) -> DataFrame:
    """(event_id, gap, count) of all rows in ``hot`` slots.

    The count at time t is the running total at the event minus the running total at t - window,
    read off a query row placed there; both come from one pass over narrow records.
    """
    at = ["source", "_slot"]
    own = timed.join(hot, at, "left_semi").select("source", "_us", "event_id", F.lit(_EVENT).alias("_kind"))
    outside = tails.join(hot, at, "left_semi").withColumn("_slot", F.col("_slot") - 1).join(hot, at, "left_anti")
    # A marker inside a hot slot would repeat one of that slot's own events.
    starts = (
        markers.join(hot, at, "left_semi")
        .withColumn("_slot", F.expr(f"(_us - pmod(_us, {width}L)) div {width}L"))
        .join(hot, at, "left_anti")
        .drop("_slot")
    )
    records = (
        own.unionByName(outside.select(*own.columns))
        .unionByName(starts, allowMissingColumns=True)
        .unionByName(own.withColumns({"_us": F.col("_us") - reach, "_kind": F.lit(_QUERY)}))
        .withColumn("_late", (F.col("_kind") == _QUERY).cast("int"))
    )
    order = ["_us", "_late", "event_id"]
    rows = slots.join(hot, at, "left_semi").agg(F.sum(F.col("n") * 2 + F.col("n_tail_before") + 1)).first()[0]
    ranged = sorted_ranges(records, ["source", *order], rows, rows_per_task)
    totals = running_totals(
        ranged,
        ["source"],
        order,
        F.col("_kind").isin(_EVENT, _TAIL).cast("int"),
        F.when(F.col("_late") == 0, F.col("_us")),
    )
    mine = F.col("_kind") == _EVENT
    return (
        totals.filter(F.col("_kind").isin(_EVENT, _QUERY))
        .groupBy("event_id")
        .agg(
            F.max(F.when(mine, _gap(F.col("_us"), F.col("before")))).alias(gap),
            F.sum(F.when(mine, F.col("total")).otherwise(-F.col("total"))).cast("double").alias(count),
        )
    )
