"""Precision and recall at every threshold of a score, with totals that run over a table of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.operators.ordered import sorted_ranges
from eventsift.storage import materialise


def threshold_counts(
    scored: DataFrame, labels: DataFrame, score: str, label: Column, id_col: str, rows_per_task: int = 2_000_000
) -> DataFrame:
    """``threshold, positives, negatives, true_positives, false_positives`` for every distinct score, highest first in rank.

    positives and negatives have exactly this score; the other two have it or a higher one. Equal scores
    are one threshold, combined before anything moves. Rows without a score, label or partner are left
    out. Distinct scores are range-partitioned; totals of earlier ranges, one row for each, are added to the running
    totals of a range, so no task sees all rows.
    """
    joined = scored.select(id_col, F.col(score).cast("double").alias("threshold")).where("threshold is not null").join(
        labels.select(id_col, label.alias("_y")).where("_y is not null"), id_col
    )
    counts = joined.groupBy("threshold").agg(F.count_if("_y").alias("positives"), F.count_if(~F.col("_y")).alias("negatives"))
    counts = materialise(counts.withColumn("_down", -F.col("threshold")), "scores")
    ranged = sorted_ranges(counts, ["_down"], counts.count(), rows_per_task)
    totals = ranged.groupBy("_pid").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_pid", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_p", "_n")])
    upto = Window.partitionBy("_pid").orderBy("_down").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({"_tp": F.sum("positives").over(upto), "_fp": F.sum("negatives").over(upto)})
    return running.join(F.broadcast(offsets), "_pid").select(
        "threshold",
        "positives",
        "negatives",
        (F.col("_tp") + F.col("_p")).alias("true_positives"),
        (F.col("_fp") + F.col("_n")).alias("false_positives"),
    )


def precision_recall_curve(counts: DataFrame) -> DataFrame:
    """``threshold_counts`` with precision and recall when everything from that score up is flagged (recall null without positives)."""
    total = counts.agg(F.sum("positives").alias("_total"))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    recall = F.when(F.col("_total") > 0, tp / F.col("_total"))
    # the total is one row
    with_total = counts.crossJoin(F.broadcast(total))
    return with_total.select(*counts.columns, (tp / (tp + fp)).alias("precision"), recall.alias("recall"))


def ranking_quality(counts: DataFrame) -> DataFrame:
    """One row: positives, negatives, average precision and the area under the ROC curve (null if a label is missing).

    Average precision adds up precision times the recall gained at each threshold. The area is the share
    of pairs of a positive and a negative row that the score has in the right order, ties half.
    """
    tp, fp = F.col("true_positives"), F.col("false_positives")
    gained = F.sum(F.col("positives") * tp / (tp + fp))
    ordered = F.sum(F.col("negatives") * (tp - F.col("positives") / 2))
    sums = counts.agg(
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
        gained.alias("_gained"),
        ordered.alias("_ordered"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(
        p, n, F.when(p > 0, F.col("_gained") / p).alias("average_precision"),
        F.when((p > 0) & (n > 0), F.col("_ordered") / (p.cast("double") * n)).alias("roc_area"),
    )
