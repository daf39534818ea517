"""TF-IDF over messages, its Gram matrix, and the projection on the leading components."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.functions.fields import tokens
from eventsift.schema import MAX_TERMS, TEXT_COMPONENTS
from eventsift.storage import materialise, spread

_MAX_PARTIALS = 20_000
_GRAM_TERMS = 1_000  # beyond it the square of the number of terms is more than a task should hold
_EXTRA_COLUMNS = 10


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


@dataclass
class Vocabulary:
    """Kept terms in alphabetical order (at most ``max_terms``) and the corpus size."""

    terms: list[str]
    doc_freq: list[int]
    n_docs: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((1 + self.n_docs) / (1 + np.asarray(self.doc_freq, dtype=float))) + 1


def message_tokens(events: DataFrame, id_col: str = "event_id", message: str = "message") -> DataFrame:
    """``id, term``: one row per token occurrence."""
    return spread(events.select(id_col, message)).select(id_col, F.explode(tokens(F.col(message))).alias("term"))


def term_frequencies(events: DataFrame, stop_words: list[str] | None = None, message: str = "message") -> DataFrame:
    """``term, corpus_freq, doc_freq``, one map-side-combined aggregate over the messages.

    Sorting a message's tokens makes its first use of a term visible from the neighbour, so the
    document frequency needs no distinct pass.
    """
    stop = default_stop_words() if stop_words is None else stop_words
    ordered = spread(events.select(message)).select(F.sort_array(tokens(F.col(message))).alias("t"))
    first = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).alias("new")))
    uses = ordered.select(F.inline(first))
    if stop:
        uses = uses.filter(~F.col("term").isin(*stop))
    return uses.groupBy("term").agg(F.count("*").alias("corpus_freq"), F.count_if("new").alias("doc_freq"))


def top_terms(frequencies: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term, term_idx, corpus_freq, doc_freq`` of the most frequent terms, ties by name."""
    kept = frequencies.orderBy(F.desc("corpus_freq"), "term").limit(max_terms)
    # Never more than max_terms rows here.
    return kept.withColumn("term_idx", F.row_number().over(Window.orderBy("term")) - 1)


def fit_vocabulary(
    events: DataFrame,
    n_docs: int,
    max_terms: int = MAX_TERMS,
    stop_words: list[str] | None = None,
    message: str = "message",
) -> Vocabulary:
    rows = top_terms(term_frequencies(events, stop_words, message), max_terms).orderBy("term_idx").collect()
    return Vocabulary([r["term"] for r in rows], [r["doc_freq"] for r in rows], n_docs)


def tfidf_weights(
    events: DataFrame, vocabulary: Vocabulary, id_col: str = "event_id", message: str = "message"
) -> DataFrame:
    """``id, term, term_idx, tf, weight``: L2-normalised smooth TF-IDF as a long table.

    A row needs nothing but its own message and the vocabulary, so nothing is shuffled.
    """
    terms, idf = vocabulary.terms, vocabulary.idf

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            row, term, tf, weight = _sparse_rows(batch.column(1), known, idf)
            columns = [batch.column(0).take(pa.array(row)), known.take(pa.array(term)), pa.array(term, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(tf, pa.int64()), pa.array(weight)], ["id", "term", "term_idx", "tf", "weight"]
            )

    found = spread(events.select(id_col, message)).select(id_col, tokens(F.col(message)).alias("tokens"))
    id_type = events.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, term string, term_idx int, tf bigint, weight double"
    return found.mapInArrow(weigh, schema).withColumnRenamed("id", id_col)


def _sparse_rows(lists: pa.Array, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row number, term number, term count and normalised weight of a batch of token lists, by row."""
    parents = pc.list_parent_indices(lists).to_numpy()
    codes = pc.index_in(pc.list_flatten(lists), vocabulary)
    known = codes.is_valid().to_numpy(zero_copy_only=False)
    term = codes.drop_null().to_numpy()
    size = len(vocabulary)
    cell, tf = np.unique(parents[known].astype(np.int64) * size + term, return_counts=True)
    row, term = np.divmod(cell, size)
    weight = tf * idf[term]
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(lists)))
    return row, term, tf, weight / norm[row]


def _add_products(gram: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
    """Add the outer product of every sparse row to ``gram``."""
    size = len(gram)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    lengths = np.diff(np.r_[starts, len(row)])
    if np.mean(lengths) > size / 8:
        for a in range(0, len(starts), 256):
            b = min(a + 256, len(starts))
            lo, hi = starts[a], starts[b] if b < len(starts) else len(row)
            dense = np.zeros((b - a, size))
            dense[np.repeat(np.arange(b - a), lengths[a:b]), term[lo:hi]] = weight[lo:hi]
            gram += dense.T @ dense
        return
    # Short rows: all pairs inside a row, a few hundred thousand at a time.
    pairs = np.cumsum(lengths * lengths)
    cuts = np.searchsorted(pairs, np.arange(500_000, pairs[-1] + 500_000, 500_000), side="left") + 1
    a = 0
    for b in np.unique(np.minimum(cuts, len(starts))):
        n, s = lengths[a:b], starts[a:b]
        left = np.repeat(np.arange(s[0], s[0] + n.sum()), np.repeat(n, n))
        first = np.repeat(s, n * n)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
        right = first + offset % np.repeat(n, n * n)
        gram += np.bincount(term[left] * size + term[right], weight[left] * weight[right], size * size).reshape(
            size, size
        )
        a = b


def gram_matrix(events: DataFrame, vocabulary: Vocabulary, message: str = "message") -> DataFrame:
    """``i, j, value`` with ``i <= j``: the non-zero entries of the TF-IDF matrix transposed times itself.

    Every task adds up its own ``max_terms`` x ``max_terms`` matrix, so what is shuffled depends
    on the number of tasks only.
    """
    terms, idf = vocabulary.terms, vocabulary.idf

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        gram = np.zeros((len(terms), len(terms)))
        for batch in batches:
            row, term, _, weight = _sparse_rows(batch.column(0), known, idf)
            if len(row):
                _add_products(gram, row, term, weight)
        i, j = np.nonzero(np.triu(gram))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])], ["i", "j", "value"]
        )

    # Every task sends up to 2 MB, so a very large table gets fewer, longer tasks.
    limit = max(_MAX_PARTIALS, 4 * events.sparkSession.sparkContext.defaultParallelism)
    messages = spread(events.select(message)).coalesce(limit)
    found = messages.select(tokens(F.col(message)).alias("tokens"))
    return found.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


@dataclass
class Components:
    """Leading right singular vectors (terms x k) and singular values."""

    loadings: np.ndarray
    singular_values: np.ndarray

    @property
    def k(self) -> int:
        return self.loadings.shape[1]


def component_count(n_terms: int, n_docs: int, wanted: int = TEXT_COMPONENTS) -> int:
    return max(1, min(wanted, max(1, n_terms - 1), max(1, n_docs - 1)))


def fit_components(
    events: DataFrame, vocabulary: Vocabulary, wanted: int = TEXT_COMPONENTS, message: str = "message", gram_terms: int = _GRAM_TERMS
) -> Components:
    """Truncated SVD without centring: from the Gram matrix up to ``gram_terms`` terms, by random projections beyond."""
    size = len(vocabulary.terms)
    k = component_count(size, vocabulary.n_docs, wanted)
    if size == 0:
        return Components(np.zeros((0, k)), np.zeros(k))
    if size > gram_terms:
        values, vectors = leading_eigenvectors(sparse_weights(events, vocabulary, message), size, k)
    else:
        entries = gram_matrix(events, vocabulary, message).toPandas()
        gram = np.zeros((size, size))
        gram[entries["i"], entries["j"]] = entries["value"]
        gram = np.triu(gram) + np.triu(gram, 1).T
        values, vectors = np.linalg.eigh(gram)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    loadings = np.zeros((size, k))
    start, known = 0, len(values)
    while start < min(k, known) and values[start] > 1e-12 * values[0]:
        end = start + 1
        while end < known and values[end - 1] - values[end] <= 1e-9 * values[0]:
            end += 1
        taken = min(end, k) - start
        loadings[:, start : start + taken] = _fixed_basis(vectors[:, start:end], taken)
        start = end
    return Components(loadings, np.sqrt(np.r_[values, np.zeros(k)][:k]))


def sparse_weights(events: DataFrame, vocabulary: Vocabulary, message: str = "message") -> DataFrame:
    """``terms, weights``: the TF-IDF row of every message with a known term, stored once for repeated products."""
    terms, idf = vocabulary.terms, vocabulary.idf

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            row, term, _, weight = _sparse_rows(batch.column(0), known, idf)
            ends = pa.array(np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)].astype(np.int32)) if len(row) else pa.array([0], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (term.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays(lists, ["terms", "weights"])

    found = spread(events.select(message)).select(tokens(F.col(message)).alias("tokens"))
    return materialise(found.mapInArrow(weigh, "terms array<int>, weights array<double>"), "weights")


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The Gram matrix of the sparse ``rows`` times ``block`` (terms x columns), without the matrix itself.

    A task adds up one block for its rows; partial blocks are added by term.
    """
    width = block.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # column by column: each then lies in one piece, and sums go straight to their terms
        own = np.ascontiguousarray(shared.value.T)
        total = np.zeros_like(own)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                term, weight = part.column(0).flatten().to_numpy().astype(np.intp), part.column(1).flatten().to_numpy()
                lengths = np.diff(part.column(0).offsets.to_numpy())
                lengths = lengths[lengths > 0]
                if len(term):
                    starts = np.cumsum(lengths) - lengths
                    for c in range(width):
                        sums = np.add.reduceat(own[c].take(term) * weight, starts)
                        total[c] += np.bincount(term, np.repeat(sums, lengths) * weight, own.shape[1])
        total = total.T
        used = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(used.astype(np.int32)), *(pa.array(total[used, c]) for c in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["term", *(f"c{c}" for c in range(width))])

    limit = max(_MAX_PARTIALS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    partial = rows.coalesce(limit).mapInArrow(multiply, "term int, " + ", ".join(f"c{c} double" for c in range(width)))
    sums = partial.groupBy("term").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)]).toPandas()
    out = np.zeros_like(block)
    out[sums["term"].to_numpy()] = sums[[f"c{c}" for c in range(width)]].to_numpy()
    return out


def leading_eigenvectors(
    rows: DataFrame, size: int, k: int, tolerance: float = 1e-10, passes: int = 40, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """At least ``k`` leading eigenvalues and eigenvectors of the Gram matrix of sparse ``rows`` over ``size`` terms.

    A random block is multiplied by the matrix again and again, and each product, made orthogonal to all before, widens
    the space in which eigenvectors are looked for. It ends when the matrix takes each of them to its multiple up to
    ``tolerance`` of the largest eigenvalue, or the space grows no more. The driver holds terms x columns only.
    """
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + _EXTRA_COLUMNS))))[0]
    basis, products = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(passes):
        product = gram_product(rows, block)
        basis, products = np.hstack([basis, block]), np.hstack([products, product])
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residual = products @ turn[:, :k] - (basis @ turn[:, :k]) * values[:k]
        if np.linalg.norm(residual, axis=0).max(initial=0.0) <= tolerance * max(values[0], 1e-300):
            break
        scale = np.linalg.norm(product, axis=0).max(initial=0.0)
        for _ in range(2):
            product = product - basis @ (basis.T @ product)
        left, sizes, _ = np.linalg.svd(product, full_matrices=False)
        block = left[:, sizes > 1e-12 * max(scale, 1e-300)]
        if not block.shape[1]:
            break
    kept = min(len(values), k + _EXTRA_COLUMNS)
    return np.clip(values[:kept], 0, None), basis @ turn[:, :kept]


def _fixed_basis(space: np.ndarray, n: int) -> np.ndarray:
    """``n`` orthonormal vectors of a space that do not depend on the basis it is given in.

    Signs and, among equal singular values, directions are free; the order in which tasks add
    up must not decide them. Each vector is the projection of the term closest to the space
    that is left, so its largest loading is positive.
    """
    rest, out = space.copy(), []
    for _ in range(n):
        norms = (rest * rest).sum(axis=1)
        at = int(np.flatnonzero(norms >= norms.max() * (1 - 1e-6))[0])
        direction = rest[at] / np.linalg.norm(rest[at])
        out.append(space @ direction)
        rest = rest - np.outer(rest @ direction, direction)
    return np.column_stack(out)


def projected(message: Column, vocabulary: Vocabulary, components: Components) -> Column:
    """Array of ``k`` component values of a message; zeros without a known term.

    Tokens are found in the JVM; the lookup and the products run on whole Arrow batches.
    """
    terms, idf, loadings = vocabulary.terms, vocabulary.idf, components.loadings
    k = components.k

    @F.arrow_udf("array<double>")
    def project(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), k))
        if terms and len(lists):
            row, term, _, weight = _sparse_rows(lists, pa.array(terms, pa.string()), idf)
            for c in range(k):
                out[:, c] = np.bincount(row, weight * loadings[term, c], minlength=len(lists))
        offsets = pa.array(np.arange(0, k * len(lists) + 1, k, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return project(tokens(message))


def components_table(spark, vocabulary: Vocabulary, components: Components) -> DataFrame:
    """``term, term_idx, doc_freq, loadings`` as a table, for storing the model."""
    rows = [
        (term, i, int(freq), [float(x) for x in components.loadings[i]])
        for i, (term, freq) in enumerate(zip(vocabulary.terms, vocabulary.doc_freq))
    ]
    return spark.createDataFrame(rows, "term string, term_idx int, doc_freq bigint, loadings array<double>")
