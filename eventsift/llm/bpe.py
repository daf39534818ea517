"""BPE encoding and decoding of whole tables through a table of distinct words."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.llm.common import Pieces, byte_letters, extended, gathered, is_plain, load_tokenizer, slices
from eventsift.storage import new_path

# Letters and numbers below U+0250 as the split pattern of the vocabulary has them.
_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
# Plain characters whose small letters are plain too: some capitals below U+0250 have theirs beyond it.
_SMALL = "".join(c for c in map(chr, range(0x250)) if is_plain(c) and is_plain(c.lower()))
_OTHER = re.compile(f"[^{re.escape(_SMALL)}]")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \t\n\r{_LETTER}{_NUMBER}]+")


_WORD_BITS, _BLOCK_BITS, _TASK_BITS = 28, 14, 21  # words of a block, blocks of a task, tasks: a place is one long


def _marked(numbers: np.ndarray, known: int) -> np.ndarray:
    """0 for the first use of each new word, whose number is the next one; number + 1 for all others."""
    codes = numbers + np.uint32(1)
    new = np.flatnonzero(numbers >= known)
    _, first = np.unique(numbers[new], return_index=True)
    codes[new[first]] = 0
    return codes


def _unmarked(codes: np.ndarray, known: int) -> np.ndarray:
    new = codes == 0
    return np.where(new, np.cumsum(new) + known - 1, codes.astype(np.int64) - 1)


class Splitter:
    """The words of a text as the tokenizer's normaliser and split pattern make them.

    Special strings are words of their own. Texts whose characters are plain in small letters take a compiled pattern, others
    the library's own steps.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Regex, pre_tokenizers

        tokenizer = load_tokenizer(path)
        split = json.loads(tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _plain_words(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return _WORD.findall(text.lower())
        return [w for w, _ in self.split(self.normalise(text))]

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.parts is None or not any(s in text for s in self.special):
            return self._plain_words(text)
        words = []
        for i, part in enumerate(self.parts.split(text)):
            words += [part] if i % 2 else self._plain_words(part)
        return words


def _place(task: int, block: int, words: int) -> int:
    """The place of the first word of a block; raises where a number has no room, so that no two blocks share one."""
    if task >> _TASK_BITS or block >> _BLOCK_BITS or words >> _WORD_BITS:
        raise OverflowError(f"task {task}, block {block} of it or a block's {words} words are beyond what a place can hold")
    return (task << _BLOCK_BITS | block) << _WORD_BITS


def _blocks(docs: DataFrame, path: str, text: str, key: str, block_chars: int, part_chars: int) -> DataFrame:
    """Documents in blocks of about ``block_chars`` characters, a row for each part of about ``part_chars``.

    A part has the keys and word counts of its documents, their words as numbers (the four bytes of each apart, which
    compresses better), and the words that are new in it, with the number of the first of them. A worker
    holds the distinct words of one block and the numbers of one part.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = ["block", "part", "keys", "lengths", "b0", "b1", "b2", "b3", "first", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, task = Splitter(path), TaskContext.get().partitionId()
        block = part = chars = chars_of_part = known = 0
        keys, lengths, codes, numbers, key_type = [], [], [], {}, pa.null()

        def flush() -> pa.RecordBatch:
            planes = np.concatenate(codes).view(np.uint8).reshape(-1, 4).T
            arrays = [
                pa.array([_place(task, block, len(numbers)) >> _WORD_BITS], pa.int64()),
                pa.array([part], pa.int32()),
                pa.array([keys]).cast(pa.list_(key_type)),
                pa.array([lengths], pa.list_(pa.int32())),
                *(pa.array([p.tobytes()], pa.binary()) for p in planes),
                pa.array([known], pa.int32()),
                pa.array([list(islice(numbers, known, None))], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in slices(batches, 64):
            key_type = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, before = splitter(t), len(numbers)
                keys.append(k)
                lengths.append(len(words))
                own = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.uint32, len(words))
                codes.append(_marked(own, before))
                chars_of_part += len(t or "") + 1
                if chars_of_part >= part_chars:
                    yield flush()
                    chars, part, known = chars + chars_of_part, part + 1, len(numbers)
                    keys, lengths, codes, chars_of_part = [], [], [], 0
                    if chars >= block_chars:
                        block, part, chars, known, numbers = block + 1, 0, 0, 0, {}
        if keys:
            yield flush()

    bytes_ = ", ".join(f"b{i} binary" for i in range(4))
    return docs.select(key, text).mapInArrow(
        run, f"block bigint, part int, keys array<{kind}>, lengths array<int>, {bytes_}, first int, words array<string>"
    )


def _encode_sorted(path: str):
    """(block, n, ids) from (place, word) rows that come sorted by word: each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, letters = load_tokenizer(path), byte_letters()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        tokenize, last, ids = tokenizer.model.tokenize, None, b""
        kind = _id_type(tokenizer)
        for batch in batches:
            out = []
            for word in batch.column(1).to_pylist():
                if word != last:
                    last = word
                    found = (
                        [special[word]]
                        if word in special
                        else [t.id for t in tokenize("".join(map(letters.__getitem__, word.encode())))]
                    )
                    ids = np.array(found, kind).tobytes()
                out.append(ids)
            place = batch.column(0).to_numpy()
            numbers = (place & ((1 << _WORD_BITS) - 1)).astype(np.int32)
            columns = [pa.array(place >> _WORD_BITS), pa.array(numbers), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "n", "ids"])

    return run


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    block_chars: int = 1 << 25,
    part_chars: int = 1 << 20,
    with_ids: bool = True,
) -> DataFrame:
    """``key``, n_tokens, ids, ids_sha256 and decoded_sha256 of every document (null text: empty).

    1. Tasks split their documents into words and number the distinct words of each block of about
       ``block_chars`` characters. Blocks are stored once, bucketed by block.
    2. The distinct words of the blocks meet by word; each distinct word is encoded once, by the model
       of the tokenizer at ``path``.
    3. Ids go back to the block and, by word number, to every position. The stored blocks are
       not shuffled: the bucketed table already lies as the join needs it.

    decoded_sha256 is of the text that the ids decode to, special tokens kept: the ids of every position joined with the
    id-to-piece table, as ``decode`` does. Keys may be null or repeated; a text is never cut; an empty table
    gives no rows. ids is left out unless ``with_ids``.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    name = f"llm_blocks_{uuid.uuid4().hex}"
    stored = _blocks(docs, path, text, key, block_chars, part_chars).write.bucketBy(parts, "block")
    stored.option("path", new_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and ``blocks`` knows them; the catalogue is left as it was
    words = blocks.select("block", "first", F.posexplode("words").alias("n", "word"))
    number = (F.col("first") + F.col("n")).cast("bigint")
    words = words.select(F.shiftleft("block", _WORD_BITS).bitwiseOR(number).alias("place"), "word")
    ids = (
        words.repartition(parts, "word")
        .sortWithinPartitions("word")
        .mapInArrow(_encode_sorted(path), "block bigint, n int, ids binary")
    )
    names = [key, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, id_type = _pieces(path), _id_type(load_tokenizer(path))
        right = right.select(["n", "ids"]).sort_by("n").combine_chunks()
        listed = right.column("ids").combine_chunks() if right.num_rows else pa.array([], pa.binary())
        flat = np.frombuffer(b"".join(listed.to_pylist()), id_type)
        lengths = pc.binary_length(listed).to_numpy().astype(np.int64) // flat.itemsize
        starts, done, known = np.cumsum(lengths) - lengths, [], 0
        key_type = left.schema.field("keys").type.value_type
        for row in left.sort_by("part").to_batches(max_chunksize=1):
            part = {c: row.column(c)[0].as_py() for c in ("lengths", "b0", "b1", "b2", "b3")}
            planes = np.stack([np.frombuffer(part[f"b{i}"], np.uint8) for i in range(4)], axis=1)
            codes = _unmarked(np.ascontiguousarray(planes).view("<u4").ravel(), known)
            known, ends = known + len(row.column("words")[0]), np.cumsum([0, *part["lengths"]])
            n, flats, shas, texts = [], [], [], []
            for a, b in zip(ends, ends[1:], strict=False):
                own = codes[a:b]
                found = gathered(flat, starts[own], np.concatenate([[0], np.cumsum(lengths[own])])).astype("<u4")
                n.append(len(found))
                flats.append(found)
                shas.append(hashlib.sha256(found.tobytes()).hexdigest())
                texts.append(hashlib.sha256(_text(pieces, found)).hexdigest())
            arrays = [row.column("keys")[0].values.cast(key_type), pa.array(n, pa.int64())]
            if with_ids:
                positions = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                arrays.append(pa.ListArray.from_arrays(positions, pa.array(np.concatenate(flats).astype(np.int32))))
            done.append(pa.RecordBatch.from_arrays([*arrays, pa.array(shas, pa.string()), pa.array(texts, pa.string())], names))
        return pa.Table.from_batches(done)

    schema = f"`{key}` {kind}, n_tokens bigint, {'ids array<int>, ' if with_ids else ''}ids_sha256 string, decoded_sha256 string"
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, schema)


def _id_type(tokenizer) -> str:
    return "<u2" if max(tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"


def _pieces(path: str) -> Pieces:
    """Pieces with a space after each, as they stand in decoded text."""
    vocabulary = load_tokenizer(path).get_vocab(with_added_tokens=True)
    return Pieces.of({i: f"{piece} ".encode() for piece, i in vocabulary.items()})


def _text(pieces: Pieces, ids: np.ndarray) -> bytes:
    return pieces.decode(ids, pieces.offsets(ids))[:-1]


def decode(encoded: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens kept; null ids give null.

    Ids meet their pieces in a map-side join: the id-to-piece table has one row per vocabulary entry, so each task holds
    it whole.
    """
    kept = [c for c in encoded.columns if c != output]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in slices(batches):
            rows = batch.column(at).to_pylist()
            texts = [None if r is None else _text(pieces, np.array(r, np.int64)).decode() for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, output])

    source = encoded.select(*kept)
    return source.mapInArrow(run, extended(source, **{output: T.StringType()}))
