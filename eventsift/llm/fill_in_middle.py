"""Fill-in-the-middle transformation: pieces of documents sorted into their new order, and back again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eventsift.llm.common import slices

#: Marks before prefix, suffix and middle in the output; texts that hold one stay plain.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Order of the parts in the output of each form.
FORMS = {"plain": ("text",), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Order of the parts in the text.
_PLACES = {"text": 0, "prefix": 0, "middle": 1, "suffix": 2}
_MARKED = {mark: part for part, mark in MARKS.items()}
_HEAD = ("_key", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
_FLUSH = 2_000_000  # code points in an outgoing batch, about


def draw(key: object, text: str, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1") -> tuple[str, int, int]:
    """Form, and where prefix and middle end in code points; they depend on seed, key and the text's length and marks."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(mark in text for mark in MARKS.values()) or h3 % 100 >= 100 - plain_percent:
        return "plain", 0, 0
    return ("spm" if h4 % 100 < spm_percent else "psm"), first, second


def _schema(key: T.DataType) -> T.StructType:
    """Rows of a unit: its head (place -1) and its pieces by place and number."""
    heads = [T.StructField("_key", key), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    heads += [T.StructField(n, T.LongType()) for n in ("prefix_chars", "middle_chars")]
    heads += [T.StructField("output_sha256", T.StringType()), T.StructField("piece", T.StringType())]
    order = [("unit", T.BinaryType()), ("place", T.IntegerType()), ("number", T.IntegerType()), ("copies", T.LongType())]
    return T.StructType([*(T.StructField(n, kind) for n, kind in order), *heads])


class _Writer:
    """Rows in batches of a bounded number of code points."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row: object) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 100 + len(row[-1] or "")
        if self.size >= _FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in slices(batches):
        yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, tuple, Iterator[str]]]:
    """unit, copies, head and the pieces in order of each unit of a sorted partition; pieces come as they are read."""
    for unit, own in groupby(_rows(batches), key=itemgetter(0)):
        copies, head, first = 0, None, None
        for row in own:
            if row[1] >= 0:
                first = row
                break
            copies, head = copies + row[3], row[4:10]

        def in_order(row=first, rest=own) -> Iterator[str]:
            last = None
            while row is not None:
                if row[1:3] != last:  # equal documents have equal pieces
                    last = row[1:3]
                    yield row[10]
                row = next(rest, None)

        yield unit, copies, head, in_order()


def _cut(text: str, chunk: int, mark: str = "") -> Iterator[str]:
    """``text`` in pieces of ``chunk`` code points, at least one, ``mark`` before the first."""
    yield mark + text[:chunk]
    for i in range(chunk, len(text), chunk):
        yield text[i : i + chunk]


def pieces(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    chunk: int = 4096,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """Every document as a head row and pieces of at most ``chunk`` code points, numbered in the order of the output.

    unit names a document by a digest of its key and whole text, so that a task which is run again names it alike.
    A null text is an empty one. Equal rows of a batch are one unit, whose head has their number in ``copies``.
    """
    schema = _schema(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(schema))
        for batch in batches:
            units: list[bytes] = []
            for k, t in _rows([batch]):
                units.append(xxhash.xxh3_128_digest(f"{k!r}:{t or ''}".encode()))
            copies: dict[bytes, int] = {}
            for unit in units:
                copies[unit] = copies.get(unit, 0) + 1
            for unit, (k, t) in zip(units, _rows([batch]), strict=True):
                if (n := copies.pop(unit, None)) is None:
                    continue
                t = t or ""
                form, first, second = draw(k, t, plain_percent, spm_percent)
                spans = {"text": t, "prefix": t[:first], "middle": t[first:second], "suffix": t[second:]}
                sizes = (None, None) if form == "plain" else (first, second - first)
                yield from writer.add(unit, -1, 0, n, k, len(t), form, *sizes, None, None)
                number = 0
                for part in FORMS[form]:
                    for piece in _cut(spans[part], chunk, MARKS.get(part, "")):
                        yield from writer.add(unit, 0, number, None, None, None, None, None, None, None, piece)
                        number += 1
        yield from writer.rest()

    return docs.select(key, text).mapInArrow(run, schema)


def _in_order(rows: DataFrame) -> DataFrame:
    """Every unit in one partition, sorted by place and number: repartitionAndSortWithinPartitions on DataFrames."""
    return rows.repartition("unit").sortWithinPartitions("unit", "place", "number")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: int) -> DataFrame:
    """``key``, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document.

    The pieces are shuffled once and sorted; output_sha256 grows piece by piece, no document is held whole. The marks
    that come by say to which part of the text a piece belongs, and the pieces, sorted once more within
    their partition by their place in the text, give restored_sha256. Texts that are null count as empty, and empty ones are plain;
    repeated rows have as many results; a null key draws like an empty one; an empty table gives no rows.
    """
    ordered = _in_order(pieces(docs, text, key, **options))
    schema, kind = ordered.schema, docs.schema[key].dataType
    result = T.StructType(
        [*(f for f in schema.fields if f.name in _HEAD), T.StructField("restored_sha256", T.StringType())]
    )

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(schema))
        for unit, copies, head, parts in _units(batches):
            digest, place = hashlib.sha256(), 0
            for number, piece in enumerate(parts):
                digest.update(piece.encode())
                if head[2] != "plain" and piece[:3] in _MARKED:
                    place, piece = _PLACES[_MARKED[piece[:3]]], piece[3:]
                yield from writer.add(unit, place, number, None, None, None, None, None, None, None, piece)
            yield from writer.add(unit, -1, 0, copies, *head[:5], digest.hexdigest(), None)
        yield from writer.rest()

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(result))
        for _, copies, head, parts in _units(batches):
            digest = hashlib.sha256()
            for piece in parts:
                digest.update(piece.encode())
            for _ in range(copies):
                yield from writer.add(*head, digest.hexdigest())
        yield from writer.rest()

    found = ordered.mapInArrow(output, schema).sortWithinPartitions("unit", "place", "number").mapInArrow(restored, result)
    return found.select(F.col("_key").cast(kind).alias(key), *found.columns[1:])


def outputs(docs: DataFrame, text: str = "text", key: str = "doc_id", **options: int) -> DataFrame:
    """``key``, n, form, prefix_chars, middle_chars and output, the transformed text, of every document."""
    ordered = _in_order(pieces(docs, text, key, **options))
    fields = [f for f in ordered.schema.fields if f.name in _HEAD[:5]]
    result = T.StructType([*fields, T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(result))
        for _, copies, head, parts in _units(batches):
            whole = "".join(parts)
            for _ in range(copies):
                yield from writer.add(*head[:5], whole)
        yield from writer.rest()

    return ordered.mapInArrow(run, result).withColumnRenamed("_key", key)


def restore(transformed: DataFrame, key: str = "doc_id", output: str = "output", form: str = "form", chunk: int = 4096) -> DataFrame:
    """``key``, form and text: the text from which each output was made.

    Outputs are cut at their marks and the pieces sorted by their place in the text. Null outputs or forms, and outputs
    whose marks are not those of their form, give a null text.
    """
    schema = _schema(transformed.schema[key].dataType)
    result = T.StructType([schema["_key"], schema["form"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(schema))
        for k, f, t in _rows(batches):
            unit = xxhash.xxh3_128_digest(f"{k!r}:{f!r}:{t!r}".encode())
            parts = _parts(f, t)
            yield from writer.add(unit, -1, 0, 1, k, None if parts is None else 0, f, None, None, None, None)
            for place, part in parts or ():
                for number, piece in enumerate(_cut(part, chunk)):
                    yield from writer.add(unit, place, number, None, None, None, None, None, None, None, piece)
        yield from writer.rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(to_arrow_schema(result))
        for _, copies, head, pieces_ in _units(batches):
            whole = None if head[1] is None else "".join(pieces_)
            for _ in range(copies):
                yield from writer.add(head[0], head[2], whole)
        yield from writer.rest()

    rows = transformed.select(key, form, output).mapInArrow(cut, schema)
    return _in_order(rows).mapInArrow(run, result).withColumnRenamed("_key", key)


def _parts(form: str | None, output: str | None) -> list[tuple[int, str]] | None:
    """(place, text) of the parts of an output; None if it is not one of ``form``."""
    if output is None or form not in FORMS:
        return None
    if form == "plain":
        return [(0, output)]
    found, rest = [], output
    marks = [MARKS[p] for p in FORMS[form]]
    for mark, following in zip(marks, [*marks[1:], None], strict=True):
        if not rest.startswith(mark):
            return None
        part, seen, rest = rest[len(mark) :].partition(following) if following else (rest[len(mark) :], "", "")
        if following and not seen:
            return None
        rest = following + rest if following else ""
        found.append((_PLACES[_MARKED[mark]], part))
    return found
