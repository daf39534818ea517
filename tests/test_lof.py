import numpy as np
import pytest
from pyspark.sql import functions as F

from eventsift.operators import lof, neighbours
from eventsift.operators.lof import local_outlier_factor
from eventsift.operators.neighbours import distinct_points, nearest_neighbours, place
from eventsift.storage import materialise


def _points(copies):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (90, 3)), rng.normal(6, 0.2, (60, 3)), rng.uniform(-20, 20, (10, 3))])
    if copies:
        x = np.vstack([x, np.repeat(x[:1], copies, axis=0), np.repeat(x[100:101], 4, axis=0)])
    return x


def _brute(x, k):
    """LOF with the copies of a point first and the smallest id among equal distances."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, nn, axis=1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(dist, kd[nn]).mean(axis=1) + 1e-10)
    return kd, lrd, lrd[nn].mean(axis=1) / lrd


@pytest.mark.parametrize("cell_rows", [10_000, 40, 12])
@pytest.mark.parametrize("copies", [0, 30])
def test_lof_matches_brute_force(spark, monkeypatch, cell_rows, copies):
    monkeypatch.setattr("eventsift.operators.lof._CROWDED", 3 if cell_rows < 40 else 10**6)
    x = _points(copies)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_id long, a double, b double, c double")
    got = sorted(local_outlier_factor(df, ["a", "b", "c"], 7, 0.05, cell_rows=cell_rows).collect())
    kd, lrd, lof = _brute(x, 7)
    np.testing.assert_allclose([r.k_distance for r in got], kd, rtol=1e-9)
    np.testing.assert_allclose([r.density for r in got], lrd, rtol=1e-6)
    np.testing.assert_allclose([r.lof for r in got], lof, rtol=1e-6)
    assert [r.is_anomaly for r in got] == list(-lof < np.percentile(-lof, 5))


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i * i)]) for i in range(5)], "event_id long, v array<double>")
    got = sorted(local_outlier_factor(df, "v", 20).collect())
    np.testing.assert_allclose([r.lof for r in got], _brute(np.array([[float(i * i)] for i in range(5)]), 4)[2])


def test_crowded_cell_is_shared(spark):
    x = np.random.default_rng(0).normal(size=(300, 2))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    edges = nearest_neighbours(distinct_points(df, "v", "id"), 60, cell_rows=5)
    sums = edges.groupBy("pid").agg(F.sum("w").alias("w"), F.max("d").alias("d")).collect()
    kd = _brute(x, 60)[0]
    assert {r.w for r in sums} == {60}
    np.testing.assert_allclose([r.d for r in sorted(sums)], kd)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_cells_are_cut_until_all_are_small(spark, bits):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(250, 2)), rng.normal(50, 0.01, size=(250, 2))])
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    points = distinct_points(df, "v", "id")
    placed, levels = place(points, 20, bits)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert levels > 1 and sum(sizes) == 500 and max(sizes) <= 40
    edges = nearest_neighbours(points, 9, cell_rows=20, bits=bits).groupBy("pid").agg(F.sum("w").alias("w"), F.max("d").alias("d"))
    rows = sorted(edges.collect())
    assert {r.w for r in rows} == {9}
    np.testing.assert_allclose([r.d for r in rows], _brute(x, 9)[0])


def test_no_points_have_no_neighbours(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert nearest_neighbours(distinct_points(none, "v", "id"), 3).collect() == []


def test_nearest_by_product_is_exact():
    # far from the origin and on a grid: products round, ties are many, some points are not finite
    rng = np.random.default_rng(5)
    y = 1e6 + rng.integers(0, 12, (700, 3)).astype(float)
    y[7, 1], y[11, 0] = np.nan, np.inf
    ids, weights = rng.permutation(700), rng.integers(1, 4, 700)
    own, bound, need = ids.copy(), np.where(np.arange(700) % 3, np.inf, 1.5), np.arange(700) % 9
    found = neighbours._nearest(y, own, bound, need, y, ids, weights)
    expected = []
    with np.errstate(invalid="ignore"):
        for i in range(700):
            d = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
            left = need[i]
            for j in np.lexsort((ids, d)):
                if np.isfinite(d[j]) and ids[j] != own[i] and d[j] <= bound[i] and left > 0:
                    expected.append((i, ids[j], d[j], weights[j]))
                    left -= weights[j]
    assert sorted(zip(*(c.tolist() for c in found), strict=True)) == sorted(expected)


def test_wide_points_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_LEAST_ROWS", 50)
    x = np.random.default_rng(6).normal(size=(260, 40))
    x[200:210] = x[:10]
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "event_id long, v array<double>")
    # boxes would make a row for nearly every pair of a point and a cell
    monkeypatch.setattr(neighbours, "_touched", None)
    got = sorted(local_outlier_factor(df, "v", 7, cell_rows=10).collect())
    kd, lrd, lof = _brute(x, 7)
    np.testing.assert_allclose([r.k_distance for r in got], kd, rtol=1e-9)
    np.testing.assert_allclose([r.lof for r in got], lof, rtol=1e-6)


def test_own_cell_sends_one_row_a_point(spark, monkeypatch):
    # neighbours go through one ranking only; before, those of the own cell and of the first cells were ranked and stored too
    ranked = []
    best = neighbours._best
    monkeypatch.setattr(neighbours, "_best", lambda edges, k: ranked.append(k) or best(edges, k))
    x = np.random.default_rng(8).normal(size=(300, 2))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    edges = nearest_neighbours(distinct_points(df, "v", "id"), 5, cell_rows=20)
    assert edges.count() == 1500 and len(ranked) == 1


def test_open_search_visits_near_boxes_only(spark):
    # a point whose cell holds too few others went to every box of the table
    kind = "node long, child long, weight long, lo array<double>, hi array<double>"
    boxes = spark.createDataFrame([(0, c, 10, [10.0 * c], [10.0 * c + 9]) for c in range(200)], kind)
    kind = "pid long, v array<double>, m long, reach double, own long, cell long"
    visits = spark.createDataFrame([(7, [51.0], 1, float("inf"), 5, 0), (8, [503.0], 1, 4.5, 50, 0)], kind)
    got = neighbours._touched(visits, boxes, 0, 15).collect()
    assert sorted((r.pid, r.cell) for r in got) == [(7, 4), (7, 6), (8, 49)]
    assert all(np.isfinite(r.reach) for r in got)


def test_lists_are_stored_by_cell(spark, monkeypatch):
    # before, a row for every neighbour was stored, ranked and joined twice
    rows = {}

    def stored(df, label):
        out = materialise(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(lof, "materialise", stored)
    x = np.random.default_rng(9).normal(size=(400, 2))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "event_id long, v array<double>")
    got = sorted(local_outlier_factor(df, "v", 12, cell_rows=60).collect())
    np.testing.assert_allclose([r.lof for r in got], _brute(x, 12)[2], rtol=1e-6)
    assert 400 <= rows["edges"] < 1600 and rows["density"] == 400


def test_rows_meet_vectors_by_number(spark):
    # sorting vectors takes most of the time of such a join
    x = [[0.0, 1.0], [-0.0, 1.0], [2.0, 1.0], [2.0, 3.0], [2.0, 3.5], [9.0, 9.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "event_id long, v array<double>")
    points = distinct_points(df, "v", "event_id")
    back = lof._back_to_rows(df, points, points.withColumnRenamed("pid", "lof"), "event_id")
    assert [tuple(r) for r in sorted(back.collect())] == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5)]
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan and "transform" not in plan[: plan.index("Aggregate")]
