import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventsift.llm import bpe, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_encoding_equals_the_library(request, name):
    docs, library = request.getfixturevalue(name), Tokenizer.from_file(WORDS)
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r["doc_id"], ids, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    got = [
        (r["doc_id"], r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
        for r in bpe.encode(docs, WORDS, block_chars=100_000, part_chars=20_000).collect()
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_decoding_gives_the_pieces_back(odd):
    library = Tokenizer.from_file(WORDS)
    encoded = bpe.encode(odd, WORDS)
    for r in bpe.decode(encoded, WORDS).collect():
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
        assert sha(r["decoded"].encode()) == r["decoded_sha256"]


@pytest.mark.parametrize("size", [1, 20_000])
@pytest.mark.parametrize("name", ["odd", "documents"])
def test_token_counts_equal_the_library(request, name, size):
    docs, library = request.getfixturevalue(name), Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(docs, BYTES, size=size, cache=50 if size == 1 else 500_000).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_empty_tables(odd):
    none = odd.where("false")
    assert bpe.encode(none, WORDS).collect() == []
    assert token_counts.count_tokens(none, BYTES).collect() == []


def test_places_without_room_are_refused():
    assert bpe._place(2, 3, 5) == (2 << 14 | 3) << 28
    for task, block, words in ((1 << 21, 0, 0), (0, 1 << 14, 0), (0, 0, 1 << 28)):
        with pytest.raises(OverflowError):
            bpe._place(task, block, words)


def test_nothing_stays_in_the_catalogue(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    assert bpe.encode(odd, WORDS).count() == odd.count()
    assert {t.name for t in spark.catalog.listTables()} == before
