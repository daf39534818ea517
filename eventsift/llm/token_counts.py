"""Token counts of a byte-level BPE without tokenising frequent pre-tokens and without moving any."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import byte_letters, extended, is_plain, load_tokenizer, text_first

# Letters and numbers below U+0250 as the pre-token pattern of byte-level BPE has them.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \t\n\r{_LETTER}{_NUMBER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)


class _Lengths(dict):
    """Token counts of pre-tokens: the broadcast tier first, then what this worker has met before."""

    def __init__(self, path: str, frequent: dict[str, int], room: int):
        super().__init__(frequent)
        self.model, self.letters = load_tokenizer(path).model, byte_letters()
        self.frequent, self.room = frequent, room

    def __missing__(self, pretoken: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, pretoken.encode()))))
        if len(self) >= self.room:
            self.clear()
            self.update(self.frequent)
        self[pretoken] = n
        return n


def _special(path: str) -> list[str]:
    return [t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()]


def _splits(path: str):
    """Whether the pre-tokens of a text can be had by the pattern here."""
    special = _special(path)
    return lambda text: is_plain(text) and not any(s in text for s in special)


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", size: int = 20_000, per_task: int = 2_000) -> dict[str, int]:
    """Token counts of the ``size`` most frequent pre-tokens, counted over all of ``docs``.

    Every task keeps a lossy count (the rarer half goes whenever ten times ``per_task`` entries are
    there) and passes on ``per_task`` pre-tokens; only these summaries meet, so the driver and the broadcast
    hold ``size`` short strings at most. What is not in the table is only slower to count.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, splits, room = Counter(), _splits(path), 10 * per_task
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and splits(t):
                    counts.update(_PRETOKEN.findall(t))
                    if len(counts) > 4 * room:
                        counts = Counter(dict(counts.most_common(room)))
        top = counts.most_common(per_task)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"]
        )

    summaries = docs.select(text).mapInArrow(count, "pretoken string, n bigint")
    top = summaries.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(size)
    lengths = _Lengths(path, {}, size + 1)
    return {r["pretoken"]: lengths[r["pretoken"]] for r in top.collect()}


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    limit: int = 512,
    size: int = 20_000,
    cache: int = 500_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with n_bytes, n_tokens and over_limit.

    Columns of these three names are replaced.

    Two tiers: a broadcast table of frequent pre-tokens, and per worker a cache of at most ``cache``
    others, encoded on first sight. No pre-token is shuffled. Texts with special strings or with
    characters whose class depends on the Unicode version go through the library as a whole. Null counts as
    empty text: 0 bytes, 0 tokens.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, size))
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, splits, library = _Lengths(path, frequent.value, cache), _splits(path), load_tokenizer(path)
        get = lengths.__getitem__
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n = [
                sum(map(get, _PRETOKEN.findall(t))) if splits(t) else len(library.encode(t, add_special_tokens=False).ids)
                for t in texts
            ]
            added = [
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*kept, *names])

    schema = extended(docs.select(*kept), n_bytes=T.LongType(), n_tokens=T.LongType(), over_limit=T.BooleanType())
    return text_first(docs, text, kept).mapInArrow(run, schema)
