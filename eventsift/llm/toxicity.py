"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import extended, plain_words, text_first

def terms(text: str | None) -> set[bytes]:
    """Distinct lower-case words, cut at ASCII punctuation."""
    return set(plain_words(text))


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) >> 33  # 31 bits: unrelated terms hardly ever meet


@dataclass
class FactorizationMachine:
    """hashes: sorted hashes of the terms that have parameters; all other terms have none."""

    hashes: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, rows: np.ndarray) -> float:
        """Bias, linear weights and all pairwise interactions of the terms ``rows`` of one text."""
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[rows].sum() + 0.5 * (total @ total - np.einsum("ij,ij->", v, v)))


def sample_labelled(labelled: DataFrame, label: str, key: str, rows_per_label: int) -> DataFrame:
    """For each of the labels 0 and 1 the ``rows_per_label`` rows of least key hash (all if there are fewer)."""
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    parts = [labelled.where(F.col(label) == y).orderBy(*order).limit(rows_per_label) for y in (0, 1)]
    return parts[0].unionAll(parts[1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    rows_per_label: int = 12_000,
    max_terms: int = 60_000,
    min_rows: int = 3,
    pair_terms: int = 2_000,
    rank: int = 4,
    epochs: int = 12,
    seed: int = 17,
) -> FactorizationMachine:
    """Fit on a bounded sample: at most ``rows_per_label`` rows of each label, sparse term hashes only.

    Rows without label, key or text teach nothing; a key that is repeated teaches once per row. Parameters go to terms
    of ``min_rows`` sampled texts or more whose share of positives is not what chance gives (chi-square
    over 10), and to both terms of every pair, among the ``pair_terms`` most frequent terms, that changes the odds in
    another way than its two terms do each by itself. The sample takes labels in other shares than the
    table has; the bias makes up for it. Without both labels, scores are the same for every text.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(
        "key is not null and label in (0, 1)"
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = sample_labelled(known, "label", "key", rows_per_label)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    texts = texts.join(F.broadcast(picked), "key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(sorted({term_hash(w) for w in terms(t)}), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["key", "label", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    sample = texts.select("key", "label", "text").mapInArrow(hashed, f"key {kind}, label int, terms binary")
    data = sorted((str(r["key"]), r["label"], bytes(r["terms"])) for r in sample.collect())
    y = np.array([r[1] for r in data], float)
    rows = [np.frombuffer(r[2], "<u4") for r in data]
    model = fit_sample(rows, y, max_terms, min_rows, pair_terms, rank, epochs, seed)
    if 0 < y.sum() < len(y):
        model.bias += float(np.log(totals[1] / totals[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _interacting(rows: list[np.ndarray], y: np.ndarray, n: int, least: float = 40.0) -> np.ndarray:
    """Which of ``n`` terms are in a pair that interacts: the log odds ratio of one differs with the other.

    The difference over its variance, from the eight counts of a pair with and without each term and label, each plus a half, is
    over ``least`` (one pair in 4e9 by chance). Counts of all pairs are products of bounded blocks.
    """
    both = np.zeros((2, n, n), np.float32)
    for label in (0, 1):
        picks = np.flatnonzero(y == label)
        for i in range(0, len(picks), 1000):
            block = np.zeros((min(1000, len(picks) - i), n), np.float32)
            for j, p in enumerate(picks[i : i + 1000]):
                block[j, rows[p]] = 1
            both[label] += block.T @ block
    interaction, variance = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for label, sign in ((1, 1), (0, -1)):
        own, total = np.diag(both[label]).copy(), np.float32((y == label).sum())
        cells = (
            (both[label], 1), (own[:, None] - both[label], -1), (own[None, :] - both[label], -1),
            (total - own[:, None] - own[None, :] + both[label], 1),
        )
        for cell, direction in cells:
            interaction += sign * direction * np.log(cell + np.float32(0.5))
            variance += 1 / (cell + np.float32(0.5))
    strong = interaction**2 > least * variance
    np.fill_diagonal(strong, False)
    return strong.any(axis=1)


def _numbered(rows: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """For each row the places of its hashes among the sorted ``hashes``; others are left out."""
    found = []
    for r in rows:
        at = np.searchsorted(hashes, r)
        at[at == len(hashes)] = 0
        found.append(at[hashes[at] == r] if len(hashes) else at[:0])
    return found


def fit_sample(
    rows: list[np.ndarray],
    y: np.ndarray,
    max_terms: int = 60_000,
    min_rows: int = 3,
    pair_terms: int = 2_000,
    rank: int = 4,
    epochs: int = 12,
    seed: int = 17,
) -> FactorizationMachine:
    """The machine for ``rows`` of distinct term hashes and their labels; its bias is that of the sample."""
    flat = np.concatenate(rows) if rows else np.zeros(0, "<u4")
    found, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    positive = np.bincount(inverse, np.repeat(y, [len(r) for r in rows]), len(found))
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    if not (0 < y.sum() < len(y)):
        return FactorizationMachine(found[:0], float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, rank)))
    chi = (positive - counts * rate) ** 2 / (np.maximum(counts, 1) * rate * (1 - rate))
    frequent = np.sort(found[np.lexsort((found, -counts))[:pair_terms]])
    paired = frequent[_interacting(_numbered(rows, frequent), y, len(frequent))]
    own = (counts >= min_rows) & (chi > 10)
    single = found[own][np.lexsort((found[own], -chi[own]))[:max_terms]]
    hashes = np.union1d(single, paired)
    linear, factors, bias = _train(_numbered(rows, hashes), y, len(hashes), rank, epochs, seed)
    return FactorizationMachine(hashes, bias, linear, factors)


def _train(own, y, n, rank, epochs, seed, l1=0.2, decay=2e-4, step=0.3, factor_step=0.1, batch=64):
    rng = np.random.default_rng(seed)
    rate = float(y.mean())
    bias, z, g2 = float(np.log(rate / (1 - rate))), np.zeros(n), np.zeros(n)
    linear, v, h2, b2 = np.zeros(n), rng.normal(0, 0.1, (n, rank)), np.full((n, rank), 1e-2), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for i in range(0, len(order), batch):
            picks = order[i : i + batch]
            flat = np.concatenate([own[p] for p in picks])
            of = np.repeat(np.arange(len(picks)), [len(own[p]) for p in picks])
            vf = v[flat]
            total = np.zeros((len(picks), rank))
            np.add.at(total, of, vf)
            squares = np.bincount(of, (vf**2).sum(axis=1), len(picks))
            margin = bias + np.bincount(of, linear[flat], len(picks)) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[picks]
            terms_, inverse = np.unique(flat, return_inverse=True)
            # linear weights: follow the regularised leader with L1
            grad = np.bincount(inverse, error[of], len(terms_))
            before = np.sqrt(g2[terms_])
            g2[terms_] += grad**2
            z[terms_] += grad - (np.sqrt(g2[terms_]) - before) / step * linear[terms_]
            zt = z[terms_]
            linear[terms_] = np.where(
                np.abs(zt) <= l1, 0.0, -(zt - np.sign(zt) * l1) / ((0.1 + np.sqrt(g2[terms_])) / step)
            )
            # factors: AdaGrad; decay for each row that has the term, so that its weight against the data is the same for all
            pull = np.zeros((len(terms_), rank))
            np.add.at(pull, inverse, error[of, None] * (total[of] - vf) + decay * vf)
            h2[terms_] += pull**2
            v[terms_] -= factor_step * pull / np.sqrt(h2[terms_])
            b2 += error.sum() ** 2
            bias -= step * error.sum() / np.sqrt(b2)
    return linear, v, float(bias)


def score(
    docs: DataFrame,
    model: FactorizationMachine,
    text: str = "text",
    keep: list[str] | None = None,
    threshold: float = 0.7,
    cache: int = 1_000_000,
) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with score (0 to 1) and predicted (score >= threshold).

    Whole texts are scored; null and empty ones get the score of a text without terms. Columns of
    these names are replaced. Each worker remembers the parameters' place of at most ``cache`` words.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        places = {int(h): i for i, h in enumerate(fm.hashes)}

        class Places(dict):
            def __missing__(self, term: bytes) -> int:
                if len(self) >= cache:
                    self.clear()
                at = self[term] = places.get(term_hash(term), -1)
                return at

        place = Places().__getitem__
        for batch in batches:
            scores = []
            for t in batch.column(0).to_pylist():
                rows = set(map(place, terms(t)))
                rows.discard(-1)
                margin = fm.margin(np.array(sorted(rows), np.int64))
                scores.append(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*kept, "score", "predicted"])

    schema = extended(docs.select(*kept), score=T.DoubleType(), predicted=T.IntegerType())
    return text_first(docs, text, kept).mapInArrow(run, schema)
