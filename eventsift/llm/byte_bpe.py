"""Byte-level BPE encoding and decoding: cut points by a scan over character classes, then cached pair merging."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventsift.llm.common import Pieces, extended, slices, text_first

# Character classes. The first three hold for a character alone, the others also look at what follows:
# an apostrophe before s, t, m, d or before re, ve, ll; white space that more white space or the end follows,
# the last white space of a run if it is a space, and if it is another character; the end of a text.
_LETTER, _NUMBER, _OTHER, _SHORT, _LONG, _WHITE, _SPACE, _BREAK, _END = range(9)
# States after a character: a token has just ended; a run of letters, numbers, others, white space; a
# space that the next token begins with; one or two letters of a contraction to come.
_OPEN, _LETTERS, _NUMBERS, _OTHERS, _WHITES, _JOINED, _ONE, _TWO = range(8)
_STATES, _BLOCK = 8, 64


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at this character."""
    if kind == _END:
        return _OPEN, False
    if state in (_ONE, _TWO):
        return (_OPEN if state == _ONE else _ONE), False
    if kind in (_WHITE, _SPACE, _BREAK):
        after = {_WHITE: _WHITES, _SPACE: _JOINED, _BREAK: _OPEN}[kind]
        return after, state != _WHITES or kind != _WHITE
    if kind in (_SHORT, _LONG):
        if state in (_OTHERS, _JOINED):
            return _OTHERS, False
        return (_ONE if kind == _SHORT else _TWO), True
    run = {_LETTER: _LETTERS, _NUMBER: _NUMBERS, _OTHER: _OTHERS}[kind]
    return run, state not in (run, _JOINED)


def _transition_functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions from state to state that runs of characters give, and what to do with them.

    images[f, s]: state s after run f. composed[f, g]: the run f, then g. of_class[c]: the function of one character.
    begins[s, c]: whether a token begins at a character of class c in state s.
    """
    steps = [[_step(s, c) for s in range(_STATES)] for c in range(_END + 1)]
    identity = tuple(range(_STATES))
    singles = [tuple(after for after, _ in row) for row in steps]
    found = {identity: 0}
    queue = [identity]
    for f in queue:
        for g in singles:
            both = tuple(g[s] for s in f)
            if both not in found:
                found[both] = len(found)
                queue.append(both)
    images = np.array(list(found), np.uint8)
    composed = np.array([[found[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
    of_class = np.array([found[f] for f in singles], np.uint16)
    begins = np.array([[steps[c][s][1] for c in range(_END + 1)] for s in range(_STATES)])
    return images, composed, of_class, begins


_IMAGES, _COMPOSED, _OF_CLASS, _BEGINS = _transition_functions()


def _exclusive_scan(functions: np.ndarray) -> np.ndarray:
    """For each place the composition of all functions before it.

    Blocks of neighbours are composed side by side, their totals scanned the same way, and carried in.
    """
    n = len(functions)
    if n <= 1:
        return np.zeros(n, np.uint16)
    blocks = -(-n // _BLOCK)
    grid = np.zeros((blocks, _BLOCK), np.uint16)  # 0 is the identity
    grid.ravel()[:n] = functions
    grid = np.ascontiguousarray(grid.T)
    total = np.zeros(blocks, np.uint16)
    for row in grid:
        total = _COMPOSED[total, row]
    carried = _exclusive_scan(total)
    out = np.empty_like(grid)
    for i, row in enumerate(grid):
        out[i] = carried
        carried = _COMPOSED[carried, row]
    return out.T.ravel()[:n]


def character_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point, as the tokenizer library has them.

    The library is asked by patterns of one class each, so that its version of Unicode decides. A last
    entry stands for the end of a text.
    """
    import tiktoken

    bytes_ = {bytes([b]): b for b in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    classes = np.full(0x110001, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_WHITE, r"\s")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_, special_tokens={})
        found = bytes(own.encode_ordinary(text)).decode()
        classes[np.array([ord(c) for c in found], np.int64)] = kind
    classes[0x110000] = _END
    return classes


def _looking_ahead(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of every code point but the last three, with regard to those that follow."""
    own = classes[points]
    kinds = own[:-3].copy()
    white = kinds == _WHITE
    last = white & (own[1:-2] != _WHITE) & (own[1:-2] != _END)
    kinds[last] = np.where(points[:-3][last] == 0x20, _SPACE, _BREAK)
    at = np.flatnonzero(points[:-3] == ord("'"))
    if len(at):
        first, second = points[at + 1], points[at + 2]
        kinds[at[np.isin(first, [ord(c) for c in "stmd"])]] = _SHORT
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        kinds[at[np.any([(first == a) & (second == b) for a, b in pairs], axis=0)]] = _LONG
    return kinds


def token_starts(texts: list[str], classes: np.ndarray, window: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(first code point of the window, places in it where a pre-token begins) over the texts, one END after each.

    Windows of ``window`` code points go through the scan one after the other; the state at the end of one begins the next.
    """
    points = np.frombuffer("\0".join([*texts, "\0\0\0"]).encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = 0x110000
    points[-3:] = 0x110000
    state, n = _OPEN, len(points) - 3
    for at in range(0, n, window):
        part = points[at : min(at + window, n) + 3]
        kinds = _looking_ahead(part, classes)
        scan = _exclusive_scan(_OF_CLASS[kinds])
        states = _IMAGES[scan, state]
        yield at, np.flatnonzero(_BEGINS[states, kinds])
        state = int(_IMAGES[_OF_CLASS[kinds[-1]], states[-1]])


def pre_tokens(texts: list[str], classes: np.ndarray, window: int = 1 << 20) -> list[list[str]]:
    """The pre-tokens of each text: the slices between neighbouring starts."""
    starts = np.concatenate([at + found for at, found in token_starts(texts, classes, window)])
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(starts, [*first.tolist(), int(sizes.sum())])
    out = []
    for i, t in enumerate(texts):
        own = (starts[bounds[i] : bounds[i + 1]] - first[i]).tolist()
        out.append([t[a:b] for a, b in zip(own, [*own[1:], len(t)], strict=False)])
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the neighbouring pair of least rank becomes one, the leftmost of equals first, until none is known."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it belongs to the part before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != j:
            continue  # one of the two has changed since
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:j])) is not None:
            heapq.heappush(heap, (r, left, j))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Encoded(dict):
    """Ids of pre-tokens as bytes, merged on first sight; short ones are remembered, ``room`` at most."""

    def __init__(self, ranks: dict[bytes, int], room: int):
        super().__init__()
        self.ranks, self.room = ranks, room

    def __missing__(self, pretoken: str) -> bytes:
        ids = np.array(merged(pretoken.encode(), self.ranks), "<u4").tobytes()
        if len(pretoken) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[pretoken] = ids
        return ids


def _pieces(path: str) -> Pieces:
    return Pieces.of({rank: token for token, rank in load_ranks(path).items()})


def _groups(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows and about ``chars`` code points; a longer text is a part of its own."""
    for part in slices([batch]):
        sizes = pc.fill_null(pc.utf8_length(part.column(0)), 0).to_pylist()
        at = total = 0
        for i, size in enumerate(sizes):
            if i > at and total + size > chars:
                yield part.slice(at, i - at)
                at, total = i, 0
            total += size
        yield part.slice(at)


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: list[str] | None = None,
    cache: int = 300_000,
    chars: int = 1_000_000,
) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with n_tokens, ids and offsets; own columns of these names are replaced.

    ids: the token ids of the whole text by the ranks at ``path``, unsigned 32-bit, little-endian. offsets: for each token the
    byte, within its text, at which it begins, and at last the length, unsigned 32-bit too. Nothing is shuffled. Null counts as empty text, which
    has no tokens; repeated rows are encoded alike; an empty table gives no rows. Every worker remembers at most ``cache``
    pre-tokens.
    """
    names = ("n_tokens", "ids", "offsets")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    classes = docs.sparkSession.sparkContext.broadcast(character_classes())  # one byte per code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, pieces, table = _Encoded(load_ranks(path), cache).__getitem__, _pieces(path), classes.value
        for batch in batches:
            for part in _groups(batch, chars):
                texts = [t or "" for t in part.column(0).to_pylist()]
                if not texts:
                    continue
                ids = [b"".join(map(get, own)) for own in pre_tokens(texts, table)]
                offsets = [pieces.offsets(np.frombuffer(i, "<u4")).astype("<u4").tobytes() for i in ids]
                added = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *added], [*kept, *names])

    schema = extended(docs.select(*kept), n_tokens=T.LongType(), ids=T.BinaryType(), offsets=T.BinaryType())
    return text_first(docs, text, kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", offsets: str = "offsets", output: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its tokens, each put at its offset; null ids or offsets give null."""
    kept = [c for c in encoded.columns if c != output]
    at, start = kept.index(ids), kept.index(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for part in slices(batches):
            found = []
            for i, o in zip(part.column(at).to_pylist(), part.column(start).to_pylist(), strict=True):
                whole = i is not None and o is not None
                found.append(pieces.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4").astype(np.int64)) if whole else None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*kept, output])

    source = encoded.select(*kept)
    return source.mapInArrow(run, extended(source, **{output: T.BinaryType()}))
