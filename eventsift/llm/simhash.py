"""Near-duplicate documents by 64-bit SimHash and multi-index hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.llm.common import map_batches
from eventsift.llm.components import components
from eventsift.storage import materialise

_CHUNK = 1 << 16


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit by bit majority of the XXH64 of all ``words``-word shingles, repeats included.

    ASCII capitals count as small letters. Fewer words make one shingle; no word gives 0.
    """
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    ends = np.cumsum([len(p) + 1 for p in parts])
    joined, last = b" ".join(parts), max(len(parts) - words + 1, 1)
    starts = [0, *ends[: last - 1].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, last, _CHUNK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3) -> DataFrame:
    """(key, fp) of every row; fp is the SimHash as a signed bigint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # one text at a time is a Python object, so that a worker keeps little memory for what comes after
        prints = np.array([simhash(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"`{key}` {kind}, fp bigint")


def _keys(fp: Column) -> Column:
    """The segments a fingerprint is listed under and those it probes, each marked by its half."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))
    ball = [F.when(F.getbit(fp, F.lit(32 + i)) == 1, high.bitwiseAND(F.lit(~(1 << i)))) for i in range(32)]
    return F.array_compact(F.array(high, low, *ball))


def _verify(bucket_rows: int):
    """Links among rows (key, fp, id) that come sorted by key, and the members of crowded keys."""

    def crowded(ids: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(prints)], ["u", "v", "fp"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last_hot = [np.zeros(0, np.int64)] * 3, None
        for batch in itertools.chain(batches, [None]):
            new = rest if batch is None else [np.concatenate([a, c.to_numpy()]) for a, c in zip(rest, batch.columns, strict=True)]
            key, prints, ids = new
            if not len(key):
                continue
            if last_hot is not None:
                hot = key == last_hot
                if hot.any():
                    yield crowded(ids[hot], prints[hot])
                key, prints, ids = key[~hot], prints[~hot], ids[~hot]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(key)))
            if len(sizes) and batch is not None and sizes[-1] <= bucket_rows:  # its rows may go on in the next batch
                at = starts[-1]
                rest, (key, prints, ids) = [key[at:], prints[at:], ids[at:]], (key[:at], prints[:at], ids[:at])
                sizes = sizes[:-1]
            else:
                rest = [a[:0] for a in (key, prints, ids)]
                last_hot = key[-1] if len(sizes) and sizes[-1] > bucket_rows else last_hot
            hot = np.repeat(sizes > bucket_rows, sizes)
            if hot.any():
                yield crowded(ids[hot], prints[hot])
                key, prints, ids = key[~hot], prints[~hot], ids[~hot]
            for step in range(1, bucket_rows):
                same = np.flatnonzero(key[step:] == key[:-step])
                if not len(same):
                    break
                far = np.bitwise_count((prints[same] ^ prints[same + step]).view(np.uint64))
                near = same[(far <= 2) & (ids[same] != ids[same + step])]
                if len(near):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[near]), pa.array(ids[near + step]), pa.nulls(len(near), pa.int64())], ["u", "v", "fp"]
                    )

    return run


def links(nodes: DataFrame, bucket_rows: int = 64) -> DataFrame:
    """(u, v) ids of ``nodes`` (id, fp), whose fingerprints are distinct; enough to connect all at 2 or fewer bits.

    Each fingerprint is listed under its two 32-bit segments. Two differing bits leave the first segment with at
    most one of them, or the second segment equal: a fingerprint probes the radius-1 ball around
    its first segment, reached from the side with the set bit, and both segments themselves. Matches are
    checked on all 64 bits.

    Segments that more than ``bucket_rows`` fingerprints hold or probe would give all pairs of a
    dense group. Their members are linked through the radius-1 balls of whole fingerprints instead: two
    fingerprints at distance 2 or less share a point of their balls, any two that share one are as near,
    and a point has 65 neighbours at most. Both ways lose no link; which one is used changes no result.
    """
    keyed = nodes.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp", "id")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = materialise(found.mapInArrow(_verify(bucket_rows), "u bigint, v bigint, fp bigint"), "found")
    dense = found.where("fp is not null").select(F.col("u").alias("id"), "fp").distinct()
    flips = [F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)]
    around = F.array("fp", *[F.col("fp").bitwiseXOR(bit) for bit in flips])
    star = (
        dense.select("id", F.explode(around).alias("point"))
        .groupBy("point")
        .agg(F.collect_list("id").alias("all"), F.min("id").alias("v"))
        .select(F.explode("all").alias("u"), "v")
        .where("u <> v")
    )
    return found.where("fp is null").select("u", "v").unionAll(star)


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, bucket_rows: int = 64
) -> DataFrame:
    """(key, fp, component_id) of every row of ``docs``, other columns left out; keys are integers.

    Fingerprints at 2 or fewer differing bits are linked; component_id is the smallest key reachable.
    Null and empty texts have fingerprint 0, linked like any other. Rows with a null key link nothing: they
    get the component of the rows with their fingerprint, null if there are none.
    Repeated rows give repeated rows; an empty table gives none.
    """
    prints = materialise(fingerprints(docs, text, key, words), "prints")
    nodes = prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).cast("bigint").alias("id"))
    nodes = materialise(nodes, "nodes")
    roots = components(links(nodes.select("id", "fp"), bucket_rows))
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
