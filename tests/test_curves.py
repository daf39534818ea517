import numpy as np
import pytest
from pyspark.sql import functions as F

from eventsift.operators.curves import precision_recall_curve, ranking_quality, threshold_counts
from eventsift.operators.quantiles import exact_quantiles


def _tables(spark, scores, labels):
    scored = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id long, score double")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y boolean")
    return scored, known


def test_curve_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr("eventsift.operators.ordered._MIN_TASK_ROWS", 5)
    rng = np.random.default_rng(2)
    scores, labels = np.round(rng.normal(size=300), 1), rng.random(300) < 0.3
    scored, known = _tables(spark, scores.tolist(), labels.tolist())
    counts = threshold_counts(scored, known, "score", F.col("y"), "id", rows_per_task=5)
    rows = precision_recall_curve(counts).collect()
    assert sorted(r["threshold"] for r in rows) == sorted(set(scores.tolist()))
    for r in rows:
        flagged = scores >= r["threshold"]
        tp = int((flagged & labels).sum())
        assert (r["true_positives"], r["false_positives"]) == (tp, int((flagged & ~labels).sum()))
        assert r["precision"] == pytest.approx(tp / flagged.sum()) and r["recall"] == pytest.approx(tp / labels.sum())
    quality = ranking_quality(counts).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in scores[labels] for b in scores[~labels]]
    assert quality["roc_area"] == pytest.approx(np.mean(pairs))
    steps = sorted(rows, key=lambda r: -r["threshold"])
    gains = np.diff([0.0, *(r["recall"] for r in steps)])
    assert quality["average_precision"] == pytest.approx(sum(g * r["precision"] for g, r in zip(gains, steps, strict=True)))


def test_curve_without_positives_or_rows(spark):
    scored, known = _tables(spark, [1.0, None, 2.0], [False, True, None])
    counts = threshold_counts(scored, known, "score", F.col("y"), "id")
    assert [tuple(r)[1:] for r in precision_recall_curve(counts).collect()] == [(0, 1, 0, 1, 0.0, None)]
    assert tuple(ranking_quality(counts).first()) == (0, 1, None, None)
    none = threshold_counts(scored.where("false"), known, "score", F.col("y"), "id")
    assert precision_recall_curve(none).collect() == [] and tuple(ranking_quality(none).first()) == (0, 0, None, None)


@pytest.mark.parametrize("shape", ["normal", "steps", "heavy"])
def test_many_quantiles_take_few_scans(spark, monkeypatch, shape):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=4000), "steps": np.round(rng.normal(size=4000)), "heavy": rng.pareto(0.3, 4000)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0]
    scans = []
    aggregated = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *e: scans.append(1) or aggregated(self, *e))
    got = exact_quantiles(df, "v", probs, in_memory_rows=200)
    np.testing.assert_allclose(got, np.quantile(x, probs), rtol=1e-12)
    if shape == "normal":
        assert len(scans) <= 2  # besides grouped counts: bounds, and the last look at the ranks
