"""Connected components by alternating large and small stars, on shuffled edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventsift.storage import materialise


def _with_least(pairs: DataFrame, in_one_task: bool) -> DataFrame:
    """``pairs`` (u, v) with m, the least of ``u`` and its neighbours.

    A node's links lie in one task only if the whole table is small enough for one; else the least is
    aggregated first and joined, which splits a node with very many links.
    """
    if in_one_task:
        return pairs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    return pairs.join(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u")


def _round(edges: DataFrame, in_one_task: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, in_one_task).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _with_least(large, in_one_task)
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return small.select(F.inline(ends)).where("u <> v").distinct()


def components(edges: DataFrame, rows_in_one_task: int = 4_000_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; root is the least node reachable.

    Each round halves paths and is written to the shared folder, so that lineage stays short and a
    lost executor costs one round at most. Self-links and repeated links do no harm; no edge, no row.
    ``rows_in_one_task`` only chooses between two plans of the same round.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    # few, even files: rounds are many and their tables small
    tasks = 2 * spark.sparkContext.defaultParallelism
    edges, state = materialise(edges.coalesce(tasks), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, edges = now, materialise(_round(edges, now[0] <= rows_in_one_task).coalesce(tasks), "links")
