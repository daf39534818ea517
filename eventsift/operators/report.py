"""Ranked results, summaries and sinks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.functions.fields import truncated
from eventsift.operators.ordered import event_positions

RESULT_COLUMNS = ["timestamp", "level", "source", "message", "anomaly_score", "is_anomaly"]


def redact_message(message: Column, max_len: int = 200) -> Column:
    """The first ``max_len`` characters and an ellipsis; ``''`` for null."""
    return truncated(message, max_len)


def with_short_messages(df: DataFrame, max_len: int = 200) -> DataFrame:
    return df.withColumn("message", truncated(F.col("message"), max_len))


def rank_results(results: DataFrame) -> DataFrame:
    """Highest score first, ties by ``event_id``."""
    return results.orderBy(F.desc("anomaly_score"), "event_id")


def top_anomalies(results: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` flagged events with the highest scores."""
    return rank_results(results.filter("is_anomaly")).limit(n)


def top_events(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` events with the highest scores, flagged or not."""
    return rank_results(results).limit(n)


def preview(events: DataFrame, n: int = 5, order: str | list[str] = "event_id") -> DataFrame:
    return events.orderBy(order).limit(n)


def sort_by_time(events: DataFrame) -> DataFrame:
    """Oldest first, events without a time last."""
    return events.orderBy(F.asc_nulls_last("timestamp"), "event_id")


def display_rows(results: DataFrame) -> DataFrame:
    """Rows of a result table: a dash for a missing level or source."""
    dash = F.lit("—")
    return with_short_messages(results).withColumns(
        {"level": F.coalesce("level", dash), "source": F.coalesce("source", dash)}
    )


def level_counts(events: DataFrame) -> DataFrame:
    """Events per level, most frequent first."""
    return events.filter("level is not null").groupBy("level").count().orderBy(F.desc("count"), "level")


def run_summary(
    results: DataFrame, fmt: str | None = None, parse_rate: float | None = None, elapsed_ms: float | None = None
) -> DataFrame:
    """One row: events, anomalies and their share, format, parse rate (in percent), run time if given.

    Format and parse rate come from the ``fmt`` and ``parsed`` columns unless given.
    """
    total, flagged = F.count("*"), F.count_if("is_anomaly")
    if fmt is not None:
        found = F.lit(fmt)
    elif "fmt" in results.columns:
        same = F.min("fmt") == F.max("fmt")
        found = F.when(total == 0, "empty").when(same, F.min("fmt")).otherwise("mixed")
    else:
        found = F.lit(None).cast("string")
    if parse_rate is not None:
        rate = F.lit(float(parse_rate))
    elif "parsed" in results.columns:
        rate = F.when(total == 0, 0.0).otherwise(F.count_if("parsed") / total)
    else:
        rate = F.lit(None).cast("double")
    return results.agg(
        total.alias("total_events"),
        flagged.alias("anomaly_count"),
        F.bround(F.when(total > 0, flagged / total * 100), 2).alias("anomaly_rate"),
        found.alias("detected_format"),
        F.bround(rate * 100, 1).alias("parse_rate"),
        *([] if elapsed_ms is None else [F.lit(round(float(elapsed_ms), 1)).alias("elapsed_ms")]),
    )


def plot_series(
    results: DataFrame, order: list[str] | None = None, normal_share: float = 1.0, seed: int = 42
) -> DataFrame:
    """``event_index, anomaly_score, is_anomaly`` and the hover fields, one row per event.

    ``normal_share`` below 1 thins out normal events for drawing; anomalies always stay.
    """
    order = order or ["event_id"]
    keep = dict.fromkeys([*order, "level", "source", "message", "anomaly_score", "is_anomaly"])
    placed = event_positions(results.select(*keep), order)
    series = placed.select("event_index", "anomaly_score", "is_anomaly", "level", "source", "message")
    if normal_share >= 1.0:
        return series
    draw = F.pmod(F.xxhash64("event_index", F.lit(seed)), F.lit(1_000_000)) < int(normal_share * 1_000_000)
    return series.filter(F.col("is_anomaly") | draw)


def write_results(
    results: DataFrame,
    path: str,
    fmt: str = "csv",
    truncate_message: bool = True,
    ranked: bool = True,
    partition_by_date: bool = False,
    mode: str = "overwrite",
) -> None:
    """Result columns as CSV (with header) or Parquet; ranked output is globally sorted over the part files.

    By date, each date is ranked on its own: its part files follow one another, few even for a busy date.
    """
    out = with_short_messages(results) if truncate_message else results
    columns = [c for c in RESULT_COLUMNS if c in out.columns]
    if partition_by_date:
        out = out.withColumn("date", F.to_date("timestamp"))
        columns.append("date")
        if ranked:
            order = ["date", F.desc("anomaly_score"), *[c for c in ("event_id",) if c in out.columns]]
            out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    elif ranked:
        out = rank_results(out)
    if fmt == "csv":
        out = _csv_times(out)
    writer = out.select(*columns).write.mode(mode)
    if partition_by_date:
        writer = writer.partitionBy("date")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def _csv_times(df: DataFrame) -> DataFrame:
    # The CSV writer alone would cut microseconds.
    return df.withColumn("timestamp", F.col("timestamp").cast("string"))


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The four event fields as CSV, for use as an input again."""
    out = _csv_times(events.select("timestamp", "level", "source", "message"))
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def detector_agreement(left: DataFrame, right: DataFrame, id_col: str = "event_id") -> DataFrame:
    """One row: events flagged by each of two detectors and by both.

    Both sides need ``is_anomaly``; ids are unique, so the join spreads evenly.
    """
    both = left.select(id_col, F.col("is_anomaly").alias("_l")).join(
        right.select(id_col, F.col("is_anomaly").alias("_r")), id_col
    )
    return both.agg(
        F.count("*").alias("events"),
        F.count_if("_l").alias("left_flagged"),
        F.count_if("_r").alias("right_flagged"),
        F.count_if(F.col("_l") & F.col("_r")).alias("flagged_by_both"),
    )


def label_metrics(results: DataFrame, labels: DataFrame, label: Column, id_col: str) -> DataFrame:
    """One row: confusion counts, precision, recall and F1 of the flags against ``label``."""
    joined = results.select(id_col, "is_anomaly").join(labels.select(id_col, label.alias("_y")), id_col)
    flagged, y = F.col("is_anomaly"), F.col("_y")
    counts = joined.agg(
        F.count_if(flagged & y).alias("true_positives"),
        F.count_if(flagged & ~y).alias("false_positives"),
        F.count_if(~flagged & y).alias("false_negatives"),
        F.count_if(~flagged & ~y).alias("true_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        "*",
        F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1"),
    )
