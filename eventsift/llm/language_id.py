"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import extended, slices, text_first

UNDETERMINED = "und"
_CHUNK = 8192
# Words only: other ASCII characters are dropped or become spaces.
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_DROPPED = bytes(b for b in range(33, 128) if not chr(b).isalpha())


def _letters(text: str) -> bytes:
    return text.lower().encode().translate(_TO_SPACE, _DROPPED)


def _cut(size: int, slice_bytes: int):
    """(lang, h, slice) of the slices of least hash that fill ``size`` bytes per language, for the texts of a task."""

    def trimmed(own: dict[int, bytes]) -> dict[int, bytes]:
        kept, total = {}, 0
        for h in sorted(own):
            if total >= size:
                break
            kept[h] = own[h]
            total += len(own[h])
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, bytes]] = {}
        held: dict[str, int] = {}
        for batch in slices(batches):
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, data = found.setdefault(lang, {}), _letters(t)
                for i in range(0, len(data), slice_bytes):
                    piece = data[i : i + slice_bytes]
                    h = xxhash.xxh3_64_intdigest(piece) >> 1
                    if h not in own and piece.strip():
                        own[h] = piece
                        held[lang] = held.get(lang, 0) + len(piece)
                if held.get(lang, 0) > 4 * size:
                    found[lang] = trimmed(own)
                    held[lang] = sum(map(len, found[lang].values()))
        for lang, own in found.items():
            own = trimmed(own)
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "slice"])

    return run


def learn_dictionaries(
    examples: DataFrame, text: str = "text", lang: str = "lang", size: int = 32_000, slice_bytes: int = 300
) -> dict[str, bytes]:
    """Raw content of ``size`` bytes for every language of ``examples``, less only where its distinct texts have less.

    The sample is bounded: whole texts are cut into slices of ``slice_bytes``, and of a language's distinct slices those of
    least hash are taken until ``size`` is full; so its content comes from all places of all its texts. Tasks
    keep no more than that of their own texts; slices then meet by language and part of the hash, and what is left by language, so that a
    language with most of the rows is the work of many tasks. The result has ``size`` bytes per language. Rows with a null text
    or language teach nothing, repeated rows once; no rows give no dictionary.
    """
    known = examples.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null and lang is not null")
    pieces = known.mapInArrow(_cut(size, slice_bytes), "lang string, h bigint, slice binary")
    pieces = pieces.groupBy("lang", "h").agg(F.min("slice").alias("slice"))
    for group in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        before = F.sum(F.length("slice")).over(Window.partitionBy(*group).orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
        pieces = pieces.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).drop("before")
    content: dict[str, bytearray] = {}
    for row in pieces.orderBy("lang", "h").toLocalIterator():
        content.setdefault(row["lang"], bytearray()).extend(bytes(row["slice"]) + b" ")
    return {k: bytes(v[:size]) for k, v in sorted(content.items())}


def _compressors(dictionaries: dict[str, bytes], level: int) -> dict[str, zstandard.ZstdCompressor]:
    found = {}
    for lang, content in dictionaries.items():
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        found[lang] = zstandard.ZstdCompressor(
            level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return found


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    keep: list[str] | None = None,
    level: int = 9,
    min_margin: float = 0.01,
) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with lang_pred, score and accepted.

    Every text is compressed whole, in pieces of 8 KB, with the dictionary of each language; the
    language with the smallest sum wins, the first by name on a tie. score is its share when a byte more
    makes a language e times less likely. A result is accepted only if the next language needs at least
    ``min_margin`` more. Null texts and texts without a letter get ``und``, score 0, not
    accepted; so does everything if no language was learned. Columns of these names are replaced; repeated rows get
    the same result each, an empty table gives none.
    """
    names = ("lang_pred", "score", "accepted")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries, level)

        def predict(t: str | None) -> tuple[str, float, bool]:
            if not t or not compressors or not any(map(str.isalpha, t)):
                return UNDETERMINED, 0.0, False
            data = _letters(t)
            pieces = [data[i : i + _CHUNK] for i in range(0, len(data), _CHUNK)]
            sizes = {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in compressors.items()}
            best, *others = sorted(sizes, key=lambda x: (sizes[x], x))
            score = 1 / sum(math.exp(sizes[best] - s) for s in sizes.values())
            return best, score, not others or sizes[others[0]] - sizes[best] >= min_margin * sizes[best]

        for batch in batches:
            found = [predict(t) for t in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *added], [*kept, *names])

    schema = extended(docs.select(*kept), lang_pred=T.StringType(), score=T.DoubleType(), accepted=T.BooleanType())
    return text_first(docs, text, kept).mapInArrow(run, schema)
