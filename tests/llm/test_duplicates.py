import hashlib
import random

import numpy as np
import pytest
import xxhash

from eventsift.llm import simhash, substring
from eventsift.llm.components import components


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "One", "one TWO", "a b c", "Ä É a b c d", "x " * 500, "the cat sat on the mat\x0b\x1cand"])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("bucket_rows", [2, 5, 64])
def test_all_near_fingerprints_are_linked(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    prints = {0, 1, (1 << 63) | 1}
    for _ in range(25):  # dense groups around a centre, chains away from it
        centre = rng.getrandbits(64)
        prints |= {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(rng.choice([1, 3, 30]))}
        for _ in range(4):
            centre ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(centre)
    ids = {f: i for i, f in enumerate(sorted(prints, key=lambda _: rng.random()))}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for f, i in ids.items()]
    nodes = spark.createDataFrame(signed, "id bigint, fp bigint")
    found = {(r["u"], r["v"]) for r in simhash.links(nodes, bucket_rows).collect()}
    near = {(ids[a], ids[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in near}
    assert roots(ids.values(), found) == roots(ids.values(), near)


@pytest.mark.parametrize("rows", [0, 4_000_000])
def test_components(spark, rows):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    edges += [(5000, i) for i in range(5001, 5200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), rows).collect()}
    expected = roots({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in expected.items() if n != r}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_near_duplicates_of_odd_rows(odd):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    # 3, 4, 5 and the row without key have no words; the other row without key has a text of its own
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 3), (None, None)} <= got
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(odd.where("false")).collect() == []


def plain_passages(rows, window=50):
    first, out = {}, []
    split = [(k, (t or "").encode().split()) for k, t in rows]
    for k, words in split:
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if k is not None:
                first[run] = min(k, first.get(run, k))
    for k, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if k is not None and first[tuple(words[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((k, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(map(repr, out))


def passages(docs, **how):
    out = []
    for r in substring.repeated_passages(docs, **how).collect():
        kept = b"" if r["n_removed"] == r["n_words"] else r["kept"].encode() if r["n_removed"] else None
        digest = r["digest"] if kept is None else hashlib.sha256(kept).hexdigest()
        out.append((r["doc_id"], r["n_words"], r["n_removed"], digest))
    return sorted(map(repr, out))


@pytest.mark.parametrize("how", [{}, {"phrases_per_shard": 3, "bytes_per_group": 500}])
def test_passages_equal_brute_force(spark, odd, how):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 60, n))
    shared = [text(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        parts = [text(rng.integers(0, 40))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(0, 5)], text(rng.integers(0, 40))]
        rows.append((int(rng.integers(0, 50)), " ".join(parts)))
    rows += [(100 + i, "same " * 70) for i in range(5)] + [(3, rows[0][1]), (200, rows[0][1] + " end")]
    rows += [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert passages(docs, **how) == plain_passages(rows)


def test_passages_of_an_empty_table(odd):
    assert substring.repeated_passages(odd.where("false")).collect() == []
