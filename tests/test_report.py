import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventsift.operators import report
from eventsift.operators.scores import contamination_sweep


@pytest.fixture(scope="module")
def results(spark):
    t = dt.datetime(2026, 6, 1)
    rows = [
        (i, t + dt.timedelta(seconds=i) if i % 4 else None, "ERROR" if i % 3 else None, f"s{i % 2}", "é" * (190 + i),
         float(i % 10) * 10, i % 10 == 9)
        for i in range(40)
    ]
    return spark.createDataFrame(
        rows,
        "event_id long, timestamp timestamp_ntz, level string, source string, message string, anomaly_score double, "
        "is_anomaly boolean",
    )


def test_truncation(spark):
    df = spark.createDataFrame([("a" * 200,), ("é" * 201,), (None,)], "m string")
    assert [r[0] for r in df.select(report.redact_message(F.col("m"))).collect()] == ["a" * 200, "é" * 200 + "…", ""]


def test_rankings(results):
    assert [r.event_id for r in report.top_anomalies(results, 3).collect()] == [9, 19, 29]
    assert [r.event_id for r in report.top_events(results, 6).collect()] == [9, 19, 29, 39, 8, 18]
    assert [r.event_id for r in report.preview(results, 2).collect()] == [0, 1]
    assert [r.event_id for r in report.sort_by_time(results).collect()][-10:] == list(range(0, 40, 4))


def test_summary_and_levels(results):
    (s,) = report.run_summary(results, "csv", 0.98765).collect()
    assert (s.total_events, s.anomaly_count, s.anomaly_rate, s.detected_format, s.parse_rate) == (40, 4, 10.0, "csv", 98.8)
    assert [tuple(r) for r in report.level_counts(results).collect()] == [("ERROR", 26)]
    (s,) = report.run_summary(results.limit(0)).collect()
    assert (s.total_events, s.anomaly_count, s.anomaly_rate) == (0, 0, None)


def test_display(results):
    first = report.display_rows(results).orderBy("event_id").first()
    assert (first.level, first.source) == ("—", "s0")


def test_plot_series_keeps_anomalies(results):
    whole = report.plot_series(results).collect()
    assert sorted(r.event_index for r in whole) == list(range(40))
    thin = report.plot_series(results, normal_share=0.3).collect()
    assert sum(r.is_anomaly for r in thin) == 4 and len(thin) < 40


def test_sinks(spark, results, tmp_path):
    report.write_results(results, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0] == "timestamp,level,source,message,anomaly_score,is_anomaly"
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 40 and back.filter(F.length("message") > 201).count() == 0
    report.write_results(results, str(tmp_path / "pq"), "parquet", truncate_message=False, partition_by_date=True)
    pq = spark.read.parquet(str(tmp_path / "pq"))
    assert pq.filter("date = '2026-06-01'").count() == 30 and pq.agg(F.max(F.length("message"))).first()[0] == 229


def test_sweep_and_agreement(spark, results):
    sweep = contamination_sweep(results, "anomaly_score", [0.05, 0.1, 0.5]).collect()
    assert [(r.contamination, r.flagged, r.total) for r in sweep] == [(0.05, 0, 40), (0.1, 4, 40), (0.5, 20, 40)]
    other = results.withColumn("is_anomaly", F.col("event_id") >= 35)
    (a,) = report.detector_agreement(results, other).collect()
    assert tuple(a) == (40, 4, 5, 1)
    (m,) = report.label_metrics(results, other.withColumn("y", F.col("is_anomaly")), F.col("y"), "event_id").collect()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.true_negatives) == (1, 3, 4, 32)
    assert (m.precision, m.recall) == (0.25, 0.2) and m.f1 == pytest.approx(2 / 9)
