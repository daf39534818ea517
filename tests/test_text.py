import math
import re

import numpy as np
import pytest

from eventsift.operators import text

MESSAGES = [
    "User 42 logged in; user 7 logged out",
    "failed login attempt for user 4471",
    "failed login attempt for user 4471",
    "connection pool exhausted é_ünï x y",
    "the of and",
    "",
    None,
    "request completed request completed REQUEST",
]


def _corpus(spark):
    return spark.createDataFrame(list(enumerate(MESSAGES)), "event_id long, message string").repartition(3)


def _expected(max_terms=500):
    stop = set(text.default_stop_words())
    docs = [[t for t in re.findall(r"(?u)\b\w\w+\b", (m or "").lower()) if t not in stop] for m in MESSAGES]
    ctf = {}
    for d in docs:
        for t in d:
            ctf[t] = ctf.get(t, 0) + 1
    terms = sorted(sorted(ctf, key=lambda t: (-ctf[t], t))[:max_terms])
    df = {t: sum(t in d for d in docs) for t in terms}
    n = len(docs)
    x = np.zeros((n, len(terms)))
    for i, d in enumerate(docs):
        for j, t in enumerate(terms):
            x[i, j] = d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1)
        norm = np.linalg.norm(x[i])
        x[i] = x[i] / norm if norm else x[i]
    return terms, df, x


@pytest.mark.parametrize("max_terms", [500, 6])
def test_weights_gram_and_projection(spark, max_terms):
    events = _corpus(spark)
    terms, df, x = _expected(max_terms)
    vocab = text.fit_vocabulary(events, len(MESSAGES), max_terms)
    assert vocab.terms == terms
    assert dict(zip(vocab.terms, vocab.doc_freq)) == df

    got = np.zeros_like(x)
    for r in text.tfidf_weights(events, vocab).collect():
        got[r.event_id, r.term_idx] = r.weight
    np.testing.assert_allclose(got, x, atol=1e-12)

    gram = np.zeros((len(terms), len(terms)))
    for r in text.gram_matrix(events, vocab).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.value
    np.testing.assert_allclose(gram, x.T @ x, atol=1e-12)

    comp = text.fit_components(events, vocab)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    k = min(8, len(terms) - 1, len(MESSAGES) - 1)
    assert comp.k == k
    np.testing.assert_allclose(comp.singular_values, s[:k], atol=1e-7)
    rows = events.select("event_id", text.projected(events.message, vocab, comp).alias("p")).collect()
    proj = np.array([r.p for r in sorted(rows)])
    np.testing.assert_allclose(proj, x @ comp.loadings, atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(proj, axis=0), s[:k], atol=1e-7)


def test_gram_of_long_rows_equals_short_row_path():
    rng = np.random.default_rng(0)
    size = 40
    for density in (0.05, 0.6):
        x = rng.random((300, size)) * (rng.random((300, size)) < density)
        row, term = np.nonzero(x)
        gram = np.zeros((size, size))
        text._add_products(gram, row, term, x[row, term])
        np.testing.assert_allclose(gram, x.T @ x, atol=1e-10)


def test_no_terms(spark):
    events = spark.createDataFrame([(1, "the"), (2, None)], "event_id long, message string")
    vocab = text.fit_vocabulary(events, 2)
    comp = text.fit_components(events, vocab)
    assert vocab.terms == [] and comp.k == 1
    assert [r.p for r in events.select(text.projected(events.message, vocab, comp).alias("p")).collect()] == [[0.0]] * 2


def test_equal_singular_values_have_fixed_directions():
    rng = np.random.default_rng(0)
    space = np.linalg.qr(rng.normal(size=(9, 3)))[0]
    turned = space @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    a, b = text._fixed_basis(space, 3), text._fixed_basis(turned, 3)
    np.testing.assert_allclose(a, b, atol=1e-12)
    np.testing.assert_allclose(a.T @ a, np.eye(3), atol=1e-12)
    np.testing.assert_allclose(text._fixed_basis(turned, 2), a[:, :2], atol=1e-12)


def test_components_of_large_vocabularies_equal_those_of_the_gram_matrix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vocabulary = text.fit_vocabulary(docs, docs.count(), 300, message="text")
    exact = text.fit_components(docs, vocabulary, 6, "text")
    projected = text.fit_components(docs, vocabulary, 6, "text", gram_terms=0)
    np.testing.assert_allclose(projected.singular_values, exact.singular_values, rtol=1e-9)
    np.testing.assert_allclose(projected.loadings, exact.loadings, atol=1e-6)


def test_components_of_few_messages_by_projection(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (3, "")], "event_id long, message string")
    vocabulary = text.fit_vocabulary(docs, 4)
    for limit in (0, 100):
        parts = text.fit_components(docs, vocabulary, 8, gram_terms=limit)
        np.testing.assert_allclose(parts.singular_values, [2**0.5, 1.0], atol=1e-12)
        np.testing.assert_allclose(np.abs(parts.loadings), [[0.5**0.5, 0], [0.5**0.5, 0], [0, 1]], atol=1e-12)
