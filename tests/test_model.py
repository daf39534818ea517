import numpy as np
import pytest

from eventsift import AnomalyDetector, analyze, analyze_events, build_feature_matrix, run_detection
from eventsift.operators import forest as fo
from eventsift.operators.scaling import fit_scaler
from eventsift.operators.scores import ScoreScale, fit_scale
from eventsift.plans.analysis import NoEventsError, load_models, score_events
from eventsift.schema import EVENT_SCHEMA, NUMERIC_FEATURES


@pytest.fixture(scope="module")
def events(spark):
    """120 events of a warehouse, one each minute or so; a burst of six critical ones at the end."""
    import datetime as dt

    rng, at, rows = np.random.default_rng(2024), dt.datetime(2025, 11, 3, 6, 30), []
    places = ["dock", "crane", "scale", "gate"]
    for i in range(114):
        at += dt.timedelta(seconds=int(rng.integers(40, 80)))
        level = "WARN" if rng.random() < 0.2 else "INFO"
        rows.append((i, at, level, places[int(rng.integers(0, 4))], f"pallet moved to aisle {rng.integers(1, 6)}"))
    for i in range(114, 120):
        at += dt.timedelta(seconds=1)
        rows.append((i, at, "CRITICAL", "crane", "hoist cable slack beyond limit on lane four, emergency brake engaged by controller, load left hanging"))
    return spark.createDataFrame(
        rows, "event_id long, timestamp timestamp_ntz, level string, source string, message string"
    ).repartition(4)


@pytest.fixture(scope="module")
def matrix(events):
    return build_feature_matrix(events)


def test_matrix_columns_are_standardised(matrix):
    table, model = matrix
    assert model.columns == [*NUMERIC_FEATURES, *[f"text_svd_{i}" for i in range(8)]]
    pdf = table.select(model.columns).toPandas()
    assert pdf.shape == (120, 15) and not pdf.isna().any().any()
    np.testing.assert_allclose(pdf.mean(), 0, atol=1e-9)
    deviation = pdf.std(ddof=0)
    assert all(abs(d - 1) < 1e-9 or abs(d) < 1e-12 for d in deviation)
    assert deviation["day_of_week"] == 0


def test_scores_have_range_and_flags(matrix):
    table, model = matrix
    scores = AnomalyDetector(contamination=0.05).fit(table).score(table)
    assert {"anomaly_score", "is_anomaly"} <= set(scores.columns)
    rows = scores.collect()
    assert len(rows) == 120
    values = [r.anomaly_score for r in rows]
    assert min(values) == 0.0 and max(values) == 100.0
    top = sorted(rows, key=lambda r: -r.anomaly_score)[:7]
    assert sum(r.level == "CRITICAL" for r in top) == 6
    # The flag is strict, so equal scores at the threshold are not flagged.
    assert sum(r.is_anomaly for r in rows) <= 6
    assert sum(r.is_anomaly for r in AnomalyDetector(0.1).fit(table).score(table).collect()) >= 6


def test_run_detection_flags(matrix):
    table, _ = matrix
    flagged = run_detection(table, contamination=0.1).filter("is_anomaly").count()
    assert 1 <= flagged <= 12


def test_same_seed_same_scores_for_any_partitioning(events, matrix):
    table, _ = matrix
    one = {r.event_id: r.anomaly_score for r in run_detection(table.coalesce(1)).collect()}
    many = {r.event_id: r.anomaly_score for r in run_detection(table.repartition(7)).collect()}
    assert one == many
    refitted = run_detection(build_feature_matrix(events.repartition(3, "message"))[0])
    assert {r.event_id: r.anomaly_score for r in refitted.collect()} == one
    other = {r.event_id: r.anomaly_score for r in run_detection(table, seed=7).collect()}
    assert one != other


def test_unfitted_detector(matrix):
    with pytest.raises(RuntimeError):
        AnomalyDetector().score(matrix[0])


def test_save_and_load(spark, events, matrix, tmp_path):
    run = analyze_events(events)
    run.save(str(tmp_path / "m"))
    features, detector = load_models(spark, str(tmp_path / "m"))
    fresh = {r.event_id: (r.anomaly_score, r.is_anomaly) for r in run.results.collect()}
    again = {r.event_id: (r.anomaly_score, r.is_anomaly) for r in score_events(events, features, detector).collect()}
    assert fresh == again
    assert detector.scale == run.detector.scale and features.columns == run.features.columns
    with pytest.raises(Exception):
        AnomalyDetector.load(str(tmp_path / "nothing"), spark=spark)


def test_no_events(spark):
    with pytest.raises(NoEventsError):
        analyze_events(spark.createDataFrame([], EVENT_SCHEMA))


def test_analyze_files(spark, tmp_path):
    lines = [f"2026-06-01 08:{i // 60:02d}:{i % 60:02d} INFO api: request {i % 7} done" for i in range(300)]
    lines += ["2026-06-01 08:05:00 ERROR auth: failed login for user 1"] * 3 + ["???"]
    (tmp_path / "a.log").write_text("\n".join(lines))
    run = analyze(spark, str(tmp_path / "a.log"))
    (s,) = run.summary().collect()
    assert (s.total_events, s.detected_format, s.parse_rate) == (304, "generic", 99.7)
    assert s.elapsed_ms > 0
    assert s.anomaly_count == run.results.filter("is_anomaly").count() > 0
    top = run.top().collect()
    assert len(top) == s.anomaly_count and "???" in {r.message for r in top}
    assert [r.anomaly_score for r in run.ranked().collect()] == sorted(
        (r.anomaly_score for r in run.results.collect()), reverse=True
    )


def test_unparsed_lines_only(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"odd line number {i % 9}" for i in range(60)))
    run = analyze(spark, str(tmp_path / "a.log"))
    rows = run.results.collect()
    assert len(rows) == 60 and run.features.gap_fill == 0.0
    assert all(0 <= r.anomaly_score <= 100 and r.timestamp is None for r in rows)


@pytest.mark.parametrize("n, trees, size", [(100, 7, 256), (1000, 20, 64), (5000, 10, 16)])
def test_tree_samples(spark, n, trees, size):
    rows = fo.sample_trees(spark.range(n).withColumnRenamed("id", "event_id"), n, trees, size).collect()
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r.tree_id, []).append(r.event_id)
    assert sorted(by_tree) == list(range(trees))
    assert all(len(v) == len(set(v)) == min(n, size) for v in by_tree.values())
    used = {e for v in by_tree.values() for e in v}
    assert len(used) > min(n, trees * size) * 0.6


def test_sample_survives_an_unlucky_cut(spark, monkeypatch):
    monkeypatch.setattr(fo.math, "sqrt", lambda _: -1e3)
    rows = fo.sample_trees(spark.range(5000).withColumnRenamed("id", "event_id"), 5000, 10, 16)
    assert rows.count() == 160


def _path_length(nodes, x):
    by_node = {n[1]: n for n in nodes}
    at = 0
    while True:
        _, node, feature, cut, size, depth = by_node[at]
        if feature < 0:
            return depth + fo.average_path(size)
        at = 2 * node + (1 if x[feature] <= cut else 2)


def test_scoring_equals_a_walk_down_every_tree(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9]]]).round(1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_id long, a double, b double, c double")
    forest = fo.fit_forest(df, ["a", "b", "c"], len(x), trees=25, max_samples=100)
    got = [r.s for r in df.select("event_id", forest.raw_score().alias("s")).orderBy("event_id").collect()]
    trees = {}
    for n in forest.nodes:
        trees.setdefault(n[0], []).append(n)
    assert all(n[5] <= 7 for n in forest.nodes)
    for i in (0, 17, 400):
        mean = np.mean([_path_length(t, x[i]) for t in trees.values()])
        assert got[i] == pytest.approx(2 ** (-mean / fo.average_path(100)))
    assert int(np.argmax(got)) == 400


def test_average_path():
    assert [fo.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert fo.average_path(256) == pytest.approx(10.244770920119127)


def test_constant_scores(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(20)], "event_id long, raw double")
    rows = fit_scale(df, "raw", 0.1).attach(df, "raw").collect()
    assert {(r.anomaly_score, r.is_anomaly) for r in rows} == {(0.0, False)}


def test_fitted_bounds_limit_the_scale(spark):
    scale = ScoreScale(0.2, 0.7, 0.6)
    df = spark.createDataFrame([(0.1,), (0.45,), (0.9,)], "raw double")
    assert [r.anomaly_score for r in scale.attach(df, "raw").collect()] == [0.0, 50.0, 100.0]


def test_scaler_of_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, 0.1), (3.0, 0.1)], "a double, b double")
    scaler = fit_scaler(df, ["a", "b"])
    assert scaler.scale == [1.0, 1.0]
    assert [tuple(r) for r in scaler.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
