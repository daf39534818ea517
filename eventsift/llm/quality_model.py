"""Quality by ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import extended, text_first

_BITS = 16
_EXTRA = 3  # shares of: words equal to the word before, words met before, lines met before
_WIDTH = (1 << _BITS) + _EXTRA
_CHUNK = 1 << 20


def _codes(data: bytes) -> np.ndarray:
    """Hash codes of all 4-byte grams."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    grams = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _shares(text: str) -> list[float]:
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    return [
        5 * sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(lines)) / m if lines else 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values): shares of hashed byte grams in the whole text, and three repetition shares."""
    text = text or ""
    data, counts = text.encode(), np.zeros(1 << _BITS, np.int64)
    for i in range(0, len(data), _CHUNK):
        piece = data[i : i + _CHUNK + 3]
        if len(piece) > 3:
            counts += np.bincount(_codes(piece), minlength=1 << _BITS)
    columns = np.flatnonzero(counts)
    values = counts[columns] / (counts.sum() + _PRIOR)
    return np.append(columns, np.arange(_WIDTH - _EXTRA, _WIDTH)), np.append(values * _SCALE, _shares(text))


_SCALE = 30.0
_PRIOR = 60  # grams added to the length of every text, so that short ones say less


@dataclass
class OrdinalModel:
    """P(grade > j) = logistic(weights . x - thresholds[j]); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """One column per grade above the lowest: the probability of at least that grade."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None, :], -30, 30)))

    def margins(self, texts: list[str | None]) -> np.ndarray:
        grams, extra = self.weights[: 1 << _BITS], self.weights[1 << _BITS :]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text:
                continue
            data, total = text.encode(), 0.0
            for at in range(0, len(data), _CHUNK):
                piece = data[at : at + _CHUNK + 3]
                if len(piece) > 3:
                    total += float(grams[_codes(piece)].sum(dtype=np.float64))
            out[i] = _SCALE * total / (max(len(data) - 3, 0) + _PRIOR) + float(extra @ np.array(_shares(text)))
        return out


def learn(
    docs: DataFrame,
    ratings: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    grade: str = "grade",
    grades: int = 3,
    max_rows: int = 12_000,
    epochs: int = 20,
    seed: int = 11,
) -> OrdinalModel:
    """Fit on a bounded sample: the ``max_rows`` rated rows of least key hash, as sparse features.

    grade is 0 to ``grades`` - 1; rows without key, grade or document teach nothing. Without any row all
    weights are zero, so every text gets the same probabilities.
    """
    rated = ratings.select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade")).where(
        f"key is not null and grade between 0 and {grades - 1}"
    )
    picked = rated.orderBy(F.xxhash64(F.col("key").cast("string")), "key", "grade").limit(max_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            columns = pa.array([c.astype("<u4").tobytes() for c, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), columns, values], ["key", "grade", "columns", "values"])

    kind = docs.schema[key].dataType.simpleString()
    sample = texts.select("key", "grade", "text").mapInArrow(
        featurise, f"key {kind}, grade int, columns binary, values binary"
    )
    data = sorted((str(r["key"]), r["grade"], bytes(r["columns"]), bytes(r["values"])) for r in sample.toLocalIterator())
    rows = [(np.frombuffer(c, "<u4"), np.frombuffer(v, "<f4")) for _, _, c, v in data]
    return _fit(rows, np.array([r[1] for r in data], int), grades, epochs, seed)


def _fit(rows, y, grades, epochs, seed, step=0.5, l2=1e-5, batch=64) -> OrdinalModel:
    rng = np.random.default_rng(seed)
    counts = np.bincount(y, minlength=grades) + 1.0
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    cuts = np.log((1 - above) / above)
    w, g2, c2 = np.zeros(_WIDTH), np.full(_WIDTH, 1e-4), np.full(grades - 1, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            picks = order[i : i + batch]
            flat = np.concatenate([rows[p][0] for p in picks])
            x = np.concatenate([rows[p][1] for p in picks])
            of = np.repeat(np.arange(len(picks)), [len(rows[p][0]) for p in picks])
            eta = np.bincount(of, w[flat] * x, len(picks))
            # cumulative probabilities around each rating, with the ends at 0 and 1
            tail = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts[None, :], -30, 30)))
            tail = np.hstack([np.ones((len(picks), 1)), tail, np.zeros((len(picks), 1))])
            here = np.arange(len(picks))
            hi, lo = tail[here, y[picks]], tail[here, y[picks] + 1]
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            grad_eta = -(d_hi - d_lo)
            grad = np.bincount(flat, grad_eta[of] * x, _WIDTH) / len(picks)
            touched = np.unique(flat)
            grad = grad[touched] + l2 * w[touched]
            g2[touched] += grad**2
            w[touched] -= step * grad / np.sqrt(g2[touched])
            moves = np.zeros(grades - 1)
            for j in range(grades - 1):
                moves[j] = (d_hi * (y[picks] == j + 1) - d_lo * (y[picks] == j)).mean()
            c2 += moves**2
            cuts = np.sort(cuts - 0.1 * moves / np.sqrt(c2))
    return OrdinalModel(w, cuts)


def rate(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with expected_grade and tails.

    tails is an array: the probability of at least grade 1, 2, ... Whole texts are rated; null and empty ones have
    no features, so only the thresholds speak. Columns of these names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("expected_grade", "tails")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = shared.value.tails(shared.value.margins(batch.column(0).to_pylist()))
            added = [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*kept, "expected_grade", "tails"])

    schema = extended(docs.select(*kept), expected_grade=T.DoubleType(), tails=T.ArrayType(T.DoubleType()))
    return text_first(docs, text, kept).mapInArrow(run, schema)


def select(docs: DataFrame, model: OrdinalModel, at_least: int = 1, probability: float = 0.5, **how) -> DataFrame:
    """``rate`` with kept: whether at least grade ``at_least`` has at least this ``probability``."""
    return rate(docs, model, **how).withColumn("kept", F.element_at("tails", at_least) >= probability)
