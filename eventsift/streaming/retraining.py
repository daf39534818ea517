"""Periodic refit on a rolling window, with versioned models."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsift.plans.analysis import Analysis, analyze_events, load_models
from eventsift.schema import DEFAULT_CONTAMINATION
from eventsift.storage import materialise


def retrain(
    events: DataFrame,
    until: dt.datetime,
    window: dt.timedelta,
    path: str,
    contamination: float = DEFAULT_CONTAMINATION,
    **feature_options,
) -> Analysis:
    """Fit on the events of ``(until - window, until]`` and save as ``path/version=<until>``.

    The time filter reaches the Parquet scan (and its partitions when the table has them).
    """
    ts = F.col("timestamp")
    recent = events.filter((ts > F.lit(until - window).cast("timestamp_ntz")) & (ts <= F.lit(until).cast("timestamp_ntz")))
    run = analyze_events(materialise(recent, "window"), contamination, **feature_options)
    run.save(f"{path}/version={until:%Y%m%dT%H%M%S}")
    # Written last: a version without it is incomplete and never loaded.
    spark = events.sparkSession
    spark.createDataFrame([(f"{until:%Y%m%dT%H%M%S}",)], "version string").coalesce(1).write.mode("append").parquet(
        f"{path}/versions"
    )
    return run


def load_latest(spark: SparkSession, path: str):
    """Feature model and detector of the newest complete version."""
    newest = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    return load_models(spark, f"{path}/version={newest}")
