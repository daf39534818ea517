"""Fitted models as small Parquet tables under one folder."""

from pyspark.sql import SparkSession
import numpy as np

from eventsift.operators.forest import NODE_SCHEMA, Forest
from eventsift.operators.scaling import Scaler
from eventsift.operators.scores import ScoreScale
from eventsift.operators.text import Components, Vocabulary, components_table


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession()


def _read(spark: SparkSession, path: str) -> list:
    rows = spark.read.parquet(path).collect()  # bounded by the model's parameters
    if not rows:
        raise ValueError(f"no model in {path}")
    return rows


_DETECTOR = (
    "contamination double, n_estimators int, max_samples int, seed bigint, id_col string, fitted_samples int, "
    "features array<string>, score_low double, score_high double, threshold double"
)


def save_detector(detector, path: str, spark: SparkSession | None = None) -> None:
    """``forest`` (nodes) and ``detector`` (parameters, threshold, score bounds)."""
    spark = _session(spark)
    forest, scale = detector.forest, detector.scale
    nodes = spark.createDataFrame(forest.nodes, NODE_SCHEMA)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    row = (
        detector.contamination, detector.n_estimators, detector.max_samples, detector.seed, detector.id_col,
        forest.max_samples, forest.features, scale.low, scale.high, scale.threshold,
    )
    spark.createDataFrame([row], _DETECTOR).coalesce(1).write.mode("overwrite").parquet(f"{path}/detector")


def load_detector(cls, path: str, contamination: float, spark: SparkSession | None = None):
    spark = _session(spark)
    row = _read(spark, f"{path}/detector")[0]
    detector = cls(contamination, row["n_estimators"], row["max_samples"], row["seed"], row["id_col"])
    nodes = [tuple(r) for r in _read(spark, f"{path}/forest")]
    detector.forest = Forest(list(row["features"]), row["n_estimators"], row["fitted_samples"], nodes)
    detector.scale = ScoreScale(row["score_low"], row["score_high"], row["threshold"])
    return detector


_FEATURES = (
    "n_rows bigint, gap_fill double, n_docs bigint, singular_values array<double>, "
    "columns array<string>, mean array<double>, scale array<double>"
)


def save_features(model, path: str, spark: SparkSession | None = None) -> None:
    """``vocabulary`` (terms, document frequencies, loadings) and ``features`` (fill value, scaling)."""
    spark = _session(spark)
    components_table(spark, model.vocabulary, model.components).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/vocabulary"
    )
    row = (
        model.n_rows, float(model.gap_fill), model.vocabulary.n_docs,
        [float(v) for v in model.components.singular_values],
        model.scaler.columns, model.scaler.mean, model.scaler.scale,
    )
    spark.createDataFrame([row], _FEATURES).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_features(path: str, spark: SparkSession | None = None):
    from eventsift.plans.features import FeatureModel

    spark = _session(spark)
    row = _read(spark, f"{path}/features")[0]
    terms = spark.read.parquet(f"{path}/vocabulary").orderBy("term_idx").collect()  # at most max_terms rows
    singular = np.array(row["singular_values"])
    loadings = np.array([r["loadings"] for r in terms]).reshape(len(terms), len(singular))
    return FeatureModel(
        row["n_rows"],
        row["gap_fill"],
        Vocabulary([r["term"] for r in terms], [r["doc_freq"] for r in terms], row["n_docs"]),
        Components(loadings, singular),
        Scaler(list(row["columns"]), list(row["mean"]), list(row["scale"])),
    )
