"""Whole runs: files or events in, ranked and summarised results out."""

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eventsift.operators import report
from eventsift.operators.parse import ParseResult, parse_log_file
from eventsift.plans.detector import AnomalyDetector
from eventsift.plans.features import FeatureModel, fit_features
from eventsift.plans.model_store import load_features, save_features
from eventsift.schema import DEFAULT_CONTAMINATION
from eventsift.sources.guard import enforce_row_limit, require_supported
from eventsift.storage import discard, materialise, scratch


@dataclass
class Analysis:
    """Result of a run: the scored events (full messages) and the fitted models."""

    results: DataFrame
    features: FeatureModel
    detector: AnomalyDetector
    elapsed_ms: float
    rejected: DataFrame | None = None
    stored: list[str] = field(default_factory=list)

    def close(self) -> None:
        """Remove the tables of this run from the shared folder; results cannot be read afterwards."""
        discard(self.results.sparkSession, self.stored)

    def __enter__(self) -> "Analysis":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def summary(self) -> DataFrame:
        return report.run_summary(self.results, elapsed_ms=self.elapsed_ms)

    def ranked(self, max_len: int = 200) -> DataFrame:
        return report.rank_results(report.with_short_messages(self.results, max_len))

    def top(self, n: int = 25) -> DataFrame:
        return report.with_short_messages(report.top_anomalies(self.results, n))

    def save(self, path: str) -> None:
        """Both models, so that raw events can be scored later."""
        save_models(self.features, self.detector, path)


class NoEventsError(ValueError):
    """The input holds no log line at all."""


def save_models(features: FeatureModel, detector: AnomalyDetector, path: str) -> None:
    save_features(features, path)
    detector.save(path)


def load_models(spark: SparkSession, path: str) -> tuple[FeatureModel, AnomalyDetector]:
    return load_features(path, spark), AnomalyDetector.load(path, spark=spark)


def analyze_events(
    events: DataFrame,
    contamination: float = DEFAULT_CONTAMINATION,
    detector: AnomalyDetector | None = None,
    **feature_options,
) -> Analysis:
    """Features, forest and scores of an event table (stored, with unique ``event_id``)."""
    start = time.perf_counter()
    if events.isEmpty():
        raise NoEventsError("no log lines were found in the input")
    with scratch() as stored:
        unscaled, model = fit_features(events, **feature_options)
        detector = detector or AnomalyDetector(contamination)
        scored = detector.fit_score(model.scaled(unscaled), model.columns, keep=events.columns)
    return Analysis(scored, model, detector, (time.perf_counter() - start) * 1000, stored=stored)


def analyze(
    spark: SparkSession,
    paths: str | list[str],
    contamination: float = DEFAULT_CONTAMINATION,
    max_rows: int | None = None,
    feature_options: dict | None = None,
    **parse_options,
) -> Analysis:
    """Parse files, then ``analyze_events``; the parsed table is stored once for all passes.

    A named file of an unsupported type is an error; files left out of folders are in ``rejected``.
    ``close`` the result (or use it in a ``with`` block) to remove the stored tables.
    """
    start = time.perf_counter()
    require_supported(spark, paths)
    with scratch() as stored:
        parsed: ParseResult = parse_log_file(spark, paths, **parse_options)
        events = materialise(enforce_row_limit(parsed.events, max_rows), "events")
    run = analyze_events(events, contamination, **(feature_options or {}))
    run.rejected, run.stored = parsed.rejected, [*stored, *run.stored]
    run.elapsed_ms = (time.perf_counter() - start) * 1000
    return run


def score_events(events: DataFrame, features: FeatureModel, detector: AnomalyDetector) -> DataFrame:
    """New events scored with saved models: nothing is refitted, scores use the fitted bounds."""
    scored = detector.score(features.transform(events), bounds="fitted")
    return scored.drop(*features.columns)
