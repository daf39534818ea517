"""Removal of long passages that earlier documents already have: anchors, sharded automata, windows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsift.llm.common import slices, words_of
from eventsift.storage import materialise

_PHRASE = 8  # words of a phrase
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[40]
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for every run of ``length`` words, from the hashes of shorter runs."""
    out, done, power = None, 0, hashes
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            part = power[done : done + len(hashes) - length + 1]
            out = part if out is None else out * _MULTIPLIERS[bit] + part
            done += 1 << bit
        if length >> bit > 1:
            step = 1 << bit
            power = power[:-step] * _MULTIPLIERS[20 + bit] + power[step:]
    return _mixed(out)


def _word_hashes(words: list[bytes], cache: _WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least phrase hash of every window, each once: equal windows have equal anchors."""
    least, width, target = _runs(hashes, _PHRASE), 1, window - _PHRASE + 1
    while 2 * width <= target:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < target:
        least = np.minimum(least[: len(least) - target + width], least[target - width :])
    return np.unique(least)


def _profiles(docs: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """(key, n_words, digest, anchors) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in slices(batches, 1024):
            n, digests, anchors = [], [], []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                found = _anchors(_word_hashes(words, cache), window) if len(words) >= window else []
                anchors.append(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
                ["key", "n_words", "digest", "anchors"],
            )

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, "key bigint, n_words bigint, digest binary, anchors array<bigint>")


def _packed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, digest, packed): the words of each text, compressed for the shuffles to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 1024):
            joined = [b" ".join(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()),
                    pa.array([pack(j) for j in joined], pa.binary()),
                ],
                ["key", "digest", "packed"],
            )

    return docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, "key bigint, digest binary, packed binary")


def _unpack(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _phrases(candidates: DataFrame) -> DataFrame:
    """(shard, phrase): the words of each recurring phrase, from the first document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in slices(batches):
            shards, phrases = [], []
            for packed, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _unpack(packed)
                hashes = _runs(_word_hashes(words, cache), _PHRASE).view(np.int64)
                wanted = {o["anchor"]: o["shard"] for o in own}
                values, places = np.unique(hashes, return_index=True)
                for value, at in zip(values.tolist(), places.tolist(), strict=True):
                    if value in wanted:
                        shards.append(wanted[value])
                        phrases.append(b" ".join(words[at : at + _PHRASE]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(phrases, pa.string())], ["shard", "phrase"])

    own = candidates.select("packed", F.filter("routes", lambda r: r["owner"] == F.col("key")).alias("own")).where(F.size("own") > 0)
    return own.mapInArrow(run, "shard bigint, phrase string")


def _locate(window: int):
    """Windows around every occurrence of a shard's phrases in its documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("shard", "key", "digest", "start", "hashes")}
        if left.num_rows and right.num_rows:
            automaton, cache = ahocorasick.Automaton(), _WordHashes()
            for phrase in set(right.column("phrase").to_pylist()):
                automaton.add_word(f" {phrase} ", 1)
            automaton.make_automaton()
            for part in slices(left.select(["shard", "key", "digest", "packed"]).to_batches()):
                for shard, key, digest, packed in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    words = _unpack(packed)
                    text = " " + b" ".join(words).decode() + " "
                    ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
                    if not len(ends) or len(words) < window:
                        continue
                    stops = np.cumsum([len(w.decode()) + 1 for w in words])
                    at = np.searchsorted(stops, ends) - _PHRASE + 1
                    n = len(words) - window + 1
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, np.maximum(at - window + _PHRASE, 0), 1)
                    np.add.at(marks, np.minimum(at + 1, n), -1)
                    covered = np.flatnonzero(np.cumsum(marks)[:n] > 0)
                    hashes = _runs(_word_hashes(words, cache), window).view(np.int64)
                    for run_ in np.split(covered, np.flatnonzero(np.diff(covered) != 1) + 1):
                        if len(run_):
                            for name, value in zip(out, (shard, key, digest, int(run_[0]), hashes[run_]), strict=True):
                                out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _cut(found: DataFrame, window: int) -> DataFrame:
    """(key, digest, n_removed, kept) from packed words and the starts of the windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, kept = [], []
            for packed, found_ in zip(batch.column(2), batch.column(3), strict=True):
                words = _unpack(packed.as_py())
                marks = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(found_.values.to_numpy())
                marks[starts] += 1
                marks[starts + window] -= 1
                gone = np.cumsum(marks)[:-1] > 0
                n.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["key", "digest", "n_removed", "kept"]
            )

    return found.select("key", "digest", "packed", "starts").mapInArrow(run, "key bigint, digest binary, n_removed bigint, kept string")


def repeated_passages(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    window: int = 50,
    phrases_per_shard: int = 10_000,
    bytes_per_group: int = 8_000_000,
) -> DataFrame:
    """(key, n_words, n_removed, digest, kept) of every row; keys are integers.

    A window is ``window`` consecutive words; words in a window that also starts in a document of smaller
    key are removed. kept holds the left words of texts that lost some but not all, else null (all words or none
    are kept); digest is the SHA-256 of all words joined by spaces.

    1. Each window is represented by its least eight-word phrase. Equal word sequences are dealt with first:
       all but the first document of a group lose all words.
    2. Phrases of two documents or more are confirmed recurring. They form shards by their first document, of about
       ``phrases_per_shard``, and each shard's Aho-Corasick automaton streams the documents that hold
       one of its phrases, in groups of about ``bytes_per_group``, so that a phrase of a third of all documents is
       located by many tasks.
    3. The windows around each occurrence meet by hash in partial aggregation, which finds the first document of
       each; later documents lose the window.

    Null texts have no words. Rows with a null key lose nothing and take nothing from others. Rows of equal
    key do not affect each other.
    """
    profiles = materialise(_profiles(docs, text, key, window), "profiles")
    usable = profiles.where(F.col("key").isNotNull() & (F.col("n_words") >= window))
    firsts = usable.groupBy("digest").agg(F.min("key").alias("first"))
    distinct = usable.join(firsts, "digest").where("key = first")
    anchored = distinct.select("key", "digest", F.explode("anchors").alias("anchor"))
    recurring = anchored.groupBy("anchor").agg(F.min("key").alias("owner"), F.max("key").alias("last"))
    recurring = materialise(recurring.where("owner < last").select("anchor", "owner"), "recurring")
    shards = max(1, math.ceil(recurring.count() / phrases_per_shard))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
    routes = (
        anchored.join(recurring, "anchor")
        .groupBy("key", "digest")
        .agg(F.collect_list(F.struct(shard.alias("shard"), "anchor", "owner")).alias("routes"))
    )
    candidates = materialise(_packed(docs, text, key).join(routes, ["key", "digest"]), "candidates")
    phrases = materialise(_phrases(candidates), "phrases")
    streamed = candidates.select(
        "key", "digest", "packed", F.explode(F.array_distinct(F.transform("routes", lambda r: r["shard"]))).alias("shard")
    )
    sizes = streamed.groupBy("shard").agg(F.sum(F.length("packed")).alias("bytes"))
    sizes = materialise(sizes.select("shard", F.ceil(F.col("bytes") / bytes_per_group).cast("bigint").alias("groups")), "shards")
    left = streamed.join(sizes, "shard").withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups")))
    right = phrases.join(sizes, "shard").select(
        "shard", "phrase", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("group")
    )
    located = materialise(
        left.select("shard", "group", "key", "digest", "packed")
        .groupBy("shard", "group")
        .cogroup(right.groupBy("shard", "group"))
        .applyInArrow(_locate(window), "shard bigint, key bigint, digest binary, start bigint, hashes array<bigint>"),
        "located",
    )
    windows = located.select("shard", "key", "digest", "start", F.posexplode("hashes").alias("i", "hash"))
    earliest = windows.groupBy("shard", "hash").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    later = (
        windows.join(earliest.where("first < last").select("shard", "hash", "first"), ["shard", "hash"])
        .where("key > first")
        .groupBy("key", "digest")
        .agg(F.collect_list(F.col("start") + F.col("i")).alias("starts"))
    )
    cut = materialise(_cut(candidates.select("key", "digest", "packed").join(later, ["key", "digest"]), window), "cut")
    copies = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return (
        profiles.select("key", "n_words", "digest")
        .join(firsts, "digest", "left")
        .join(cut.select("key", "digest", F.col("n_removed").alias("cut"), "kept"), ["key", "digest"], "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.when(copies, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("bigint").alias("n_removed"),
            F.lower(F.hex("digest")).alias("digest"),
            F.when(~copies, F.col("kept")).alias("kept"),
        )
    )
