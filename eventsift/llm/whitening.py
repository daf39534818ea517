"""Whitening of embeddings: distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import extended

#: Entries become whole numbers floor(SCALE * c) + OFFSET; those beyond LIMIT count as LIMIT.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 50
_EXTENDED = np.longdouble


def usable(vector: str | Column) -> Column:
    """Whether a vector has entries, none of them null or not finite."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(entries) > 0) & ~bad, F.lit(False))


def _whole(vectors: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows of whole numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET
    return scaled.reshape(len(vectors), -1) if len(vectors) else scaled.reshape(0, 0)


@dataclass
class Whitening:
    """n, sums: rows and per-dimension sums of the fit list; values, vectors: eigenvalues, falling, and unit eigenvectors.

    identity_error is measured on the whitened fit list; None until then, and if no component has any spread.
    """

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def components(self) -> int:
        return self.vectors.shape[1]

    @property
    def spread(self) -> np.ndarray:
        """Which components have any spread beyond rounding."""
        floor = len(self.sums) * np.finfo(float).eps * max(float(np.trace(self.covariance)), 0.0)
        return self.values > floor

    def explained(self) -> list[float | None]:
        """The share of each eigenvalue in the trace of the covariance; None if the trace is zero."""
        trace = float(np.trace(self.covariance))
        return [v / trace if trace > 0 else None for v in self.values.tolist()]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows, one column per component; not a number in components without spread."""
        centre, rest = _centre(self.sums, self.n)
        scale = np.where(self.spread, np.sqrt(np.where(self.spread, self.values, 1.0)), np.nan)
        return ((x - centre).astype(np.float64) - rest) @ (self.vectors / scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n * x - S) ** 2 for each row; None beyond a long."""
        sums = np.array(self.sums, object)
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 63:
            apart = self.n * x - np.array(self.sums, np.int64)
            if int(np.abs(apart).max(initial=0)) ** 2 * max(len(sums), 1) < 1 << 63:
                return (apart**2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers nearest to the means, and means minus these, from exact sums."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    rest = [(s - n * w) / n for s, w in zip(sums, whole, strict=True)]
    return np.array(whole, np.int64), np.array(rest, np.float64)


def _partial_sums(vectors: DataFrame, step: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of the matrices that ``step`` gives for a batch: one per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += step(_whole(batch.column(0)))
        at = np.arange(total.size, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "part"])

    rows = vectors.mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()
    found = np.zeros(shape)
    found.flat[[r["at"] for r in rows]] = [r["total"] for r in rows]
    return found


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact per-dimension sums of the most frequent vector length (the greatest on a tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                x = _whole(batch.column(0).filter(pa.array(lengths == d)))
                counts[d] = counts.get(d, 0) + len(x)
                # halves of the numbers, so that a batch of great numbers does not run over
                high, low = (x >> 30).sum(axis=0), (x & ((1 << 30) - 1)).sum(axis=0)
                sums[d] = sums.get(d, 0) + high.astype(object) * (1 << 30) + low
        rows = [(d, i, counts[d], str(s)) for d in counts for i, s in enumerate(sums[d])]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["d", "i", "n", "s"])

    parts = vectors.mapInArrow(run, "d int, i int, n bigint, s string")
    totals = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    chosen = totals.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).select("d")
    rows = sorted(totals.join(F.broadcast(chosen), "d").collect(), key=lambda r: r["i"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def fit(table: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening:
    """Means, covariance and the first ``components`` eigenvectors over all usable vectors of ``table``.

    Vectors that are null, empty or hold null or non-finite entries are left out, so are those of another
    length than the most frequent one. Two passes: exact sums, then products of the centred numbers; each task sends one
    matrix of its partial sums, and only these meet. Repeated rows count as often as they occur. An
    empty table gives no components. Fewer dimensions than ``components`` give as many components as dimensions.
    """
    vectors = table.where(usable(vector)).select(F.transform(vector, lambda c: c.cast("double")).alias("v"))
    n, sums = _sums(vectors)
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    whole, rest = _centre(sums, n)

    def products(x: np.ndarray) -> np.ndarray:
        centred = (x - whole).astype(np.float64) - rest
        return centred.T @ centred

    same = vectors.where(F.size("v") == d)
    covariance = _partial_sums(same, products, (d, d)) / n
    covariance = (covariance + covariance.T) / 2
    values, full = eigen(covariance)
    model = Whitening(n, sums, covariance, values[:components], full[:, :components])

    def whitened(x: np.ndarray) -> np.ndarray:
        w = model.project(x)[:, model.spread]
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    k = int(model.spread.sum())
    if k:
        # the covariance of what is returned, measured on it
        total = _partial_sums(same, whitened, (k + 1, k)) / n
        measured = total[:k] - np.outer(total[k], total[k])
        model.identity_error = float(np.abs(measured - np.eye(k)).max())
    return model


def eigen(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision.

    Eigenvectors of the matrix in float32 are the start. Every round multiplies matrices in extended precision: with
    R = I - X'X and S = X'AX, the correction of eigenvector j along i is (S_ij + l_j R_ij) / (l_j - l_i), and half of R_ij
    where the two eigenvalues cannot be told apart yet. Each such cluster of eigenvalues is first
    solved by itself: A, less the mean of the cluster, restricted to its vectors.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not d or scale == 0.0:
        return np.zeros(d), np.eye(d)
    a = matrix.astype(_EXTENDED) / _EXTENDED(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_EXTENDED)
    norm, eps, before = float(np.linalg.norm(a.astype(float), 2)), float(np.finfo(np.float64).eps), np.inf
    for _ in range(rounds):
        values, r, s = _state(a, x)
        gap = 2 * (float(np.abs(s - np.diag(values)).max()) + norm * float(np.abs(r).max())) * np.sqrt(d)
        gap = max(gap, 4 * d * float(np.finfo(_EXTENDED).eps) * norm)
        order = np.argsort(values.astype(float))
        x, values = x[:, order], values[order]
        clusters = _clusters(values, gap)
        if clusters:
            for c in clusters:
                x[:, c] = _subsolve(a, x[:, c])
            values, r, s = _state(a, x)
        else:
            r, s = r[np.ix_(order, order)], s[np.ix_(order, order)]
        distance = values[None, :] - values[:, None]
        far = np.abs(distance) > gap
        correction = np.where(far, (s + values[None, :] * r) / np.where(far, distance, 1), r / 2)
        x = x + x @ correction
        now = float(np.abs(correction).max())
        if now < eps / 16 or 1e-8 > now > before / 2:  # small enough, or rounding is all that is left
            break
        before = now
    x = _polished(x)
    values = _state(a, x)[0]
    order = np.argsort(-values.astype(float), kind="stable")
    return (values[order] * scale).astype(float), x[:, order].astype(float)


def _state(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalue estimates, R = I - X'X and S = X'AX."""
    r, s = np.eye(len(a), dtype=_EXTENDED) - x.T @ x, x.T @ (a @ x)
    s = (s + s.T) / 2
    return np.diag(s) / (1 - np.diag(r)), r, s


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more rising eigenvalues whose neighbours are at most ``gap`` apart."""
    ends = [0, *(np.flatnonzero(np.diff(values) > gap) + 1).tolist(), len(values)]
    return [slice(i, j) for i, j in zip(ends, ends[1:], strict=False) if j - i > 1]


def _subsolve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Vectors of one cluster, turned to the eigenvectors of A less the cluster's mean within their span."""
    x = _polished(x)
    centre = np.trace(x.T @ (a @ x)) / x.shape[1]
    inner = x.T @ (a @ x - centre * x)
    inner = (inner + inner.T) / 2
    size = np.abs(inner).max()
    if float(size) == 0.0:
        return x
    turn = np.linalg.eigh((inner / size).astype(float))[1].astype(_EXTENDED)
    return _polished(x @ turn)


def _polished(x: np.ndarray) -> np.ndarray:
    """The nearest orthonormal columns, by two Newton steps."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=_EXTENDED) - x.T @ x) / 2
    return x


def whiten(
    table: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """One row per usable vector with the columns ``keep`` (``key`` if not given), deviation and whitened (array<double>).

    deviation: sum over the dimensions of (n x - S) ** 2, exact, null beyond a long. whitened: the projections of x - S / n
    over the roots of the eigenvalues, null in components without spread. Vectors that ``fit`` leaves out have no row.
    """
    kept = [key] if keep is None else keep
    good = table.where(usable(vector) & (F.size(vector) == len(model.sums)))
    source = good.select(F.transform(vector, lambda c: c.cast("double")).alias("_v"), *[F.col(c) for c in kept])
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(0))
            flat = own.project(x).ravel()
            values = pa.array(flat, pa.float64(), from_pandas=True)
            ends = np.arange(0, len(flat) + 1, max(own.components, 1), dtype=np.int32)
            columns = [pa.array(own.deviations(x), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*kept, "deviation", "whitened"])

    schema = extended(source.select(*kept), deviation=T.LongType(), whitened=T.ArrayType(T.DoubleType()))
    return source.mapInArrow(run, schema)
