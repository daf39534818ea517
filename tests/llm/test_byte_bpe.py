import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from eventsift.llm import byte_bpe
from eventsift.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return byte_bpe.character_classes()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_cut_points_equal_the_pattern(classes):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "1", "²", "!", "'s", "é", "你", "　", "́", "S"]
    random.seed(5)
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(5000)]
    want = [pattern.findall(t) for t in texts]
    assert byte_bpe.pre_tokens(texts, classes) == want
    for window in (1, 2, 5, 64, 65):
        assert byte_bpe.pre_tokens(texts[:300], classes, window) == want[:300]


def test_scan_equals_single_steps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        kinds = rng.integers(0, 9, n)
        scan, state = byte_bpe._exclusive_scan(byte_bpe._OF_CLASS[kinds]), 0
        for f, kind in zip(scan.tolist(), kinds.tolist(), strict=True):
            assert byte_bpe._IMAGES[f, 0] == state
            state = byte_bpe._step(state, kind)[0]


def test_every_character_has_the_class_of_the_library(library, classes):
    texts = [f"{chr(c)}a{chr(c)}1{chr(c)} {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    ranks = byte_bpe.load_ranks(PATH)
    got = [[i for p in own for i in byte_bpe.merged(p.encode(), ranks)] for own in byte_bpe.pre_tokens(texts, classes)]
    assert got == library.encode_ordinary_batch(texts)


def test_merging_equals_the_library(library):
    ranks = byte_bpe.load_ranks(PATH)
    random.seed(4)
    for size in (1, 2, 3, 10, 60, 3000):
        for letters in ("a", "ab", "etaoin shrdlu", "é你ß"):
            piece = "".join(random.choices(letters, k=size)).encode()
            assert byte_bpe.merged(piece, ranks) == library._encode_single_piece(piece)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_encoding_equals_the_library(request, library, name):
    docs = request.getfixturevalue(name)
    encoded = byte_bpe.encode(docs, PATH, chars=20_000, cache=100)
    assert encoded.columns == [c for c in docs.columns if c != "ids" and c != "n_tokens"] + ["n_tokens", "ids", "offsets"]
    got = byte_bpe.decode(encoded, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) == (len(ids), ids, text.encode())
        lengths = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert np.frombuffer(r["offsets"], "<u4").tolist() == [0, *np.cumsum(lengths).tolist()]


def test_query_and_empty_tables(spark, library, odd):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == sha((texts[r["doc_id"]] or "").encode())
    assert byte_bpe.decode(byte_bpe.encode(odd.where("false"), PATH), PATH).collect() == []
