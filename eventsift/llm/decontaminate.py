"""Benchmark items in training documents: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import extended, keeping_columns, plain_words, text_first

_MATCH, _MISMATCH, _GAP = 2, -1, -1


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(share, first, last): best local alignment as a share of a full match, and where it ends in ``passage``.

    Two points for an equal word, minus one for a changed, missing or added one. Words are numbers; 0 equals
    nothing. first is the earliest word the alignment can start at.
    """
    n, at = len(passage), np.arange(len(passage))
    above, begin_above = np.zeros(n), at.copy()
    best, first, last = 0.0, 0, 0
    for word in item:
        step = np.where((passage == word) & (word > 0), _MATCH, _MISMATCH)
        diagonal = np.append(0.0, above[:-1]) + step
        begin = np.append(0, begin_above[:-1])
        begin[np.append(True, above[:-1] <= 0)] = at[np.append(True, above[:-1] <= 0)]
        up = above + _GAP
        row = np.maximum(np.maximum(diagonal, up), 0)
        begin = np.where(up > diagonal, begin_above, begin)
        # words of the passage left out: the best of all cells to the left, less their distance
        slanted = row - _GAP * at
        run = np.maximum.accumulate(slanted)
        source = np.maximum.accumulate(np.where(slanted == run, at, 0))
        row, begin = run + _GAP * at, begin[source]
        top = int(row.argmax())
        if row[top] > best:
            best, first, last = float(row[top]), int(begin[top]), top
        above, begin_above = row, begin
    return best / (_MATCH * max(len(item), 1)), first, last


@dataclass
class Seeds:
    """Items of one block as word numbers, and their n-grams by length."""

    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    grams: dict[int, np.ndarray]  # length: sorted distinct codes
    base: dict[int, int]  # length: number of the first seed
    owners: list[list[tuple[int, int]]]  # seed number: (item, place in it)

    @classmethod
    def of(cls, texts: list[str | None], n: int) -> Seeds:
        vocabulary: dict[bytes, int] = {}
        items = [
            np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in plain_words(t)], np.int64) for t in texts
        ]
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, item in enumerate(items):
            length = min(n, len(item))
            if length:
                for place, code in enumerate(_codes(item, length, len(vocabulary) + 1).tolist()):
                    found.setdefault(length, {}).setdefault(code, []).append((i, place))
        grams, base, owners = {}, {}, []
        for length in sorted(found):
            grams[length], base[length] = np.array(sorted(found[length]), np.int64), len(owners)
            owners += [found[length][c] for c in sorted(found[length])]
        return cls(vocabulary, items, grams, base, owners)

    def numbers(self, text: str | None) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, seed number) of every seed in a text."""
        places, seeds = [], []
        for length, codes in self.grams.items():
            if len(numbers) < length or not len(codes):
                continue
            known = numbers > 0
            full = known[: len(numbers) - length + 1].copy()
            for k in range(1, length):
                full &= known[k : len(numbers) - length + 1 + k]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            own = np.zeros(len(at), np.int64)
            for k in range(length):
                own = own * (len(self.vocabulary) + 1) + numbers[at + k]
            found = np.searchsorted(codes, own)
            found[found == len(codes)] = 0
            right = codes[found] == own
            places.append(at[right])
            seeds.append(found[right] + self.base[length])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(seeds)


def _codes(numbers: np.ndarray, length: int, width: int) -> np.ndarray:
    codes = np.zeros(len(numbers) - length + 1, np.int64)
    for k in range(length):
        codes = codes * width + numbers[k : len(numbers) - length + 1 + k]
    return codes


def _word_counts(docs: DataFrame, text: str, seeds: Seeds) -> tuple[np.ndarray, int, int]:
    """Occurrences of each benchmark word over all of ``docs``, and the numbers of words and documents."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value, 0
        counts = np.zeros(len(own.vocabulary) + 1, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0).to_pylist():
                counts += np.bincount(own.numbers(t), minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(counts[met], rows))], ["word", "n"])

    sums = docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts, rows = np.zeros(len(seeds.vocabulary) + 1, np.int64), 0
    for r in sums.collect():
        if r["word"] < 0:
            rows = r["n"]
        else:
            counts[r["word"]] = r["n"]
    return counts, int(counts.sum()), rows


def _rare(seeds: Seeds, counts: np.ndarray, words: int, rows: int, rare_share: float) -> np.ndarray:
    """Seeds whose words would meet by chance in ``rare_share`` of the documents at most.

    Chance is judged by the words' own frequencies, not by that of the seed, which copies of an item raise. An
    item with few such seeds keeps the rarer half of its own.
    """
    chance = np.zeros(len(seeds.owners))
    of_item: list[list[int]] = [[] for _ in seeds.items]
    length = np.zeros(len(seeds.owners), np.int64)
    for n, base in seeds.base.items():
        length[base : base + len(seeds.grams[n])] = n
    for s, owners in enumerate(seeds.owners):
        i, at = owners[0]
        share = (counts[seeds.items[i][at : at + length[s]]] + 1) / (words + 1)
        chance[s] = share.prod() * words / max(rows, 1)
        for i in {i for i, _ in owners}:
            of_item[i].append(s)
    rare = chance <= rare_share
    for own in of_item:
        if own:
            own = np.array(own)
            rare[own[chance[own] <= np.median(chance[own])]] = True
    return rare


def _matches(seeds: Seeds, rare: np.ndarray, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item, score, seeds, first word, last word) of every item found in one text."""
    numbers = seeds.numbers(text)
    places, hit = seeds.hits(numbers)
    windows: dict[int, list[tuple[int, int]]] = {}
    for place, s in zip(places[rare[hit]].tolist(), hit[rare[hit]].tolist(), strict=True):
        for i, at in seeds.owners[s]:
            size = len(seeds.items[i])
            windows.setdefault(i, []).append((max(place - at - size // 2 - 2, 0), place - at + size + size // 2 + 2))
    found = []
    for i, spans in windows.items():
        spans.sort()
        best, lo, hi = (0.0, 0, 0), *spans[0]
        for a, b in [*spans[1:], (len(numbers) + 1, 0)]:
            if a <= hi and b:
                hi = max(hi, b)
                continue
            share, first, last = alignment(seeds.items[i], numbers[lo:hi])
            if share > best[0]:
                best = (share, lo + first, lo + last)
            lo, hi = a, b
        if best[0] >= threshold:
            found.append((i, best[0], len(spans), best[1], best[2]))
    return sorted(found)


def match_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    n: int = 3,
    threshold: float = 0.5,
    rare_share: float = 1e-4,
    block_items: int = 5_000,
) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with matches, an array of
    (item, score, seeds, first_word, last_word).

    Every item is searched in every whole text. Seeds are word n-grams of an item (all its words if it has fewer).
    Those that are rare lead to passages: by the frequencies of their words, counted over all of ``docs``, chance
    puts them into ``rare_share`` of the documents at most; an item always keeps the rarer half of its seeds. Each
    passage is aligned with the item. score is the alignment as a share of a full match, so an edited copy still
    scores; ``threshold`` or more is a match. Items go through in blocks of ``block_items``, so
    a task holds one block whatever the benchmark's size. Words are lower case without ASCII punctuation. Null
    or empty texts and items match nothing; items with a null key are left out; repeated items match alike.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "matches"]
    kind = items.schema[item_key].dataType
    struct = T.StructType(
        [
            T.StructField("item", kind),
            T.StructField("score", T.DoubleType()),
            T.StructField("seeds", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
        ]
    )
    schema = extended(docs.select(*kept), matches=T.ArrayType(struct))
    rows = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("k is not null").orderBy("k", "t").toLocalIterator()
    found = text_first(docs, text, kept).withColumn("matches", F.lit(None).cast(T.ArrayType(struct)))
    with_text = T.StructType([found.schema.fields[0], *schema.fields])
    while block := list(itertools.islice(rows, block_items)):
        seeds = Seeds.of([r["t"] for r in block], n)
        rare = _rare(seeds, *_word_counts(docs, text, seeds), rare_share)
        found = _with_matches(found, seeds, rare, [r["k"] for r in block], threshold, with_text)
    return found.select(*kept, F.coalesce("matches", F.array().cast(T.ArrayType(struct))).alias("matches"))


def _with_matches(found: DataFrame, seeds: Seeds, rare: np.ndarray, keys: list, threshold: float, schema: T.StructType) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((seeds, rare, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rare_, names = shared.value
        for batch in batches:
            out = []
            for t, before in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                new = [
                    {"item": names[i], "score": s, "seeds": k, "first_word": a, "last_word": b}
                    for i, s, k, a, b in _matches(own, rare_, t, threshold)
                ]
                out.append((before or []) + new)
            column = pa.array(out, batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], batch.schema.names)

    return found.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    return keeping_columns(docs, ["matches"], lambda d: match_items(d, items, **how).where(F.size("matches") == 0))
