from fractions import Fraction

import numpy as np
import pytest

from eventsift.llm import whitening
from eventsift.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def exact_covariance(x):
    """Covariance of whole numbers, divisor n, in fractions."""
    n, sums = len(x), x.sum(axis=0).tolist()
    centred = x.astype(object) * n - np.array(sums, object)
    return np.array([[float(Fraction(int(v), n**3)) for v in row] for row in centred.T @ centred]), sums


def test_query_against_numpy(spark):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    x = np.floor(np.array(list(table.values()), float) * 64).astype(np.int64) + 1_000_000
    covariance, sums = exact_covariance(x)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    rows = QUERIES["op11_whitening"](spark, FOLDER).collect()
    assert len(rows) == 32 * len(table)
    n = len(x)
    deviation = dict(zip(table, ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist(), strict=True))
    got = {k: np.zeros(32) for k in table}
    for r in rows:
        got[r["vec_id"]][r["component"] - 1] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(covariance), rel=1e-12)
        assert 0 <= r["identity_error"] < 1e-9
    w = np.array([got[k] for k in table])
    expected = (x - np.array(sums) / n) @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((w * expected).sum(axis=0))
    assert np.abs(w - expected * signs).max() < 1e-8
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize("gaps", [[], [0.0], [1e-13], [1e-9], [1e-6], [1e-13, 1e-6, 0.0]])
def test_eigenvectors_to_double_precision(gaps):
    rng = np.random.default_rng(len(gaps))
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = np.sort(rng.uniform(1, 100, 40))[::-1].copy()
    for i, gap in enumerate(gaps):
        values[5 * i + 3 : 5 * i + 6] = values[5 * i + 3] - gap * np.arange(3)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * found).max() < 5e-13
    # far better than the float32 start
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(start.T @ a @ start - np.diag(np.diag(start.T @ a @ start))).max() > 1e-6


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, -0.25]), (2, [0.5, 1.0, -0.25]), (3, None), (4, []), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]),
        (7, [None, 1.0, 2.0]), (8, [1.0, 2.0]), (None, [2.0, -1.0, 0.125]), (9, [0.0, 0.0, 3.0]), (10, [1e-3, -1e-3, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("deviation", whitening.F.lit("own"))
    model = whitening.fit(table, components=5)
    assert (model.n, model.components) == (5, 3)
    found = whitening.whiten(table, model, keep=["vec_id"]).collect()
    assert sorted((r["vec_id"] or 0) for r in found) == [0, 1, 2, 9, 10]
    same = {r["vec_id"]: r["whitened"] for r in found}
    assert same[1] == same[2] and len(same[1]) == 3


def test_tables_without_spread_and_without_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    model = whitening.fit(same)
    assert model.identity_error is None and model.explained() == [None, None]
    assert [(r["deviation"], r["whitened"]) for r in whitening.whiten(same, model).collect()] == [(0, [None, None])] * 4
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id bigint, embedding array<float>")
    model = whitening.fit(flat)
    assert model.identity_error < 1e-9
    assert sorted(abs(r["whitened"][0]) for r in whitening.whiten(flat, model).collect()) == pytest.approx([1, 1])
    none = same.where("false")
    model = whitening.fit(none)
    assert (model.n, model.components) == (0, 0) and whitening.whiten(none, model).collect() == []


def test_deviations_are_exact_beyond_doubles():
    sums = [3_000_000_001, 2_999_999_999]
    model = whitening.Whitening(3000, sums, np.eye(2), np.ones(2), np.eye(2))
    x = np.array([[1_000_123, 999_877], [10**15, 0]])
    exact = [sum((3000 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert model.deviations(x[:1]) == exact[:1]
    assert model.deviations(x) == [exact[0], None] and exact[1] >= 1 << 63
