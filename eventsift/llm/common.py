"""What the operators of this subpackage share: table access, word splitting, Arrow output."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: ASCII white space as the contracts name it: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"\x20\x09-\x0D"

#: Characters whose classes and lower case are the same in every Unicode version in use. Texts with
#: others are split by the tokenizers library itself.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_plain(text: str) -> bool:
    return _PLAIN.search(text) is None


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between runs of ASCII white space; none for null."""
    return text.encode().split() if text else []


def extended(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])


_TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8, cut at white space and ASCII punctuation; none for null."""
    return text.lower().encode().translate(_TO_SPACE).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_first(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The text of ``docs`` under a name that none of the ``kept`` columns has, then these."""
    name = "_text"
    while name in {c.lower() for c in kept}:
        name += "_"
    return docs.select(docs[text].alias(name), *kept)


def keeping_columns(docs: DataFrame, added: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``step``, which adds columns ``added``; own columns of these names survive."""
    away, taken = {}, {c.lower() for c in [*docs.columns, *added]}
    for column in docs.columns:
        if column.lower() in {a.lower() for a in added}:
            name = column
            while name.lower() in taken:
                name += "_"
            away[column] = name
            taken.add(name.lower())
    after = step(docs.withColumnsRenamed(away) if away else docs)
    return after.select(*[after[away.get(c, c)].alias(c) for c in docs.columns])


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df`` through ``function``, one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def load_tokenizer(path: str):
    """The tokenizer of a file; tasks load it once or a few times, in well under a second."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the letters from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@dataclass
class Pieces:
    """The id-to-piece table of a vocabulary: the bytes of all pieces in one row, and where each begins.

    Ids are small whole numbers, so joining ids with their pieces is reading at their places, for all ids of a text at
    once. Ids without a piece have no bytes.
    """

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, pieces: dict[int, bytes]) -> Pieces:
        listed = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
        lengths = np.array([len(t) for t in listed], np.int64)
        return cls(np.frombuffer(b"".join(listed), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id begin in the decoded text, and at last its length."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of ``ids``, each copied to its offset."""
        return gathered(self.data, self.starts[ids], offsets).tobytes()


def gathered(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of ``data`` that begin at ``starts``, one after the other at ``offsets`` (one more: the end)."""
    return data[np.repeat(starts - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])]
