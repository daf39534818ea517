import re
from collections import Counter

import numpy as np
import pytest

from eventsift.llm import decontaminate, lines, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if counts[run] > 1:
            covered.update(range(i, i + 8))
    own = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered))


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_statistics_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = quality_rules.statistics(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_statistics(r["text"])


def test_ratios_and_verdicts(spark, odd):
    good = [(i, "the river and the house stand by the old green wood " * 2 + "the end") for i in range(40)]
    poor = [(100 + i, "the### river$$$ and*** the### house&&& stand### by### the### old### green### wood### " * 2) for i in range(20)]
    docs = spark.createDataFrame(good + poor, "doc_id bigint, text string")
    ratios = quality_rules.likelihood_ratios(docs, docs.where("doc_id < 30"), size=1 << 10)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ratios, size=1 << 10, max_repeat_share=100).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not any(got[100 + i]["kept"] for i in range(20))
    values = ratios.first()["ratios"]
    assert len(values) == 2 << 10
    # shares of both sides sum to one
    both = {r["doc_id"]: r["score"] for r in quality_rules.judge(docs, ratios, size=1 << 10).collect()}
    assert both[0] > 0 > both[100]
    judged = quality_rules.judge(odd, ratios, size=1 << 10).collect()
    assert len(judged) == odd.count()
    assert all(r["score"] is None and r["base_failed"] and not r["kept"] for r in judged if not WORD.search(r["text"] or ""))
    none = odd.where("false")
    assert quality_rules.judge(none, quality_rules.likelihood_ratios(none, none)).collect() == []


def plain_lines(rows, sites=5):
    bare = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x)
    seen, first = {}, {}
    for k, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if bare(x):
                seen.setdefault(bare(x), set()).add(s)
                if k is not None:
                    first[bare(x)] = min(k, first.get(bare(x), k))
    out = []
    for k, t, s in rows:
        if t is None:
            out.append((k, None, 0))
            continue
        own = t.split("\n")
        left = [x for x in own if not bare(x) or len(seen[bare(x)]) < sites or k is not None and first.get(bare(x)) == k]
        out.append((k, "\n".join(left), len(own) - len(left)))
    return sorted(map(repr, out))


def test_lines_equal_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        picks = [f"line {int(x)}" for x in np.minimum(rng.zipf(1.3, rng.integers(1, 12)), 60)]
        rows.append((int(rng.integers(0, 350)), "\n".join(picks + [""] * int(rng.integers(0, 2))), f"s{int(rng.integers(0, 12))}"))
    rows += [(None, "line 1\nown", "s1"), (500, "  line 1 \n\nline 2", None), (501, "line 1", None)]
    rows += [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = lines.dedup_lines(docs).collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"], r["n_lines_removed"]) for r in got])) == plain_lines(rows)
    cleaned = lines.dedup_lines(odd, min_sites=2)
    assert cleaned.columns == [*odd.columns, "n_lines_removed"] and cleaned.count() == odd.count()
    assert lines.dedup_lines(odd.where("false")).collect() == []


def plain_alignment(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b and a else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(item))


def test_alignment_equals_plain_dynamic_programme():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, passage = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))
        share, first, last = decontaminate.alignment(item, passage)
        assert share == plain_alignment(item, passage)
        if share:
            assert first <= last < len(passage)


@pytest.mark.parametrize("block", [2, 5_000])
def test_copied_and_edited_items_are_found(spark, odd, block):
    rng = np.random.default_rng(6)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    items = [text(30) for _ in range(6)] + [["lone", "pair"]]
    rows, expected = [], set()
    for d in range(120):
        words = text(200)
        if d % 3 == 0:
            i = d % 6
            copy = list(items[i])
            if d % 2:  # every seventh word changed, one left out
                copy[::7] = [f"z{x}" for x in range(len(copy[::7]))]
                del copy[10]
            words[50:50] = copy
            expected.add((d, i))
        rows.append((d, "  ".join(words).title() + "."))
    rows.append((500, "a lone, pair of socks"))
    expected.add((500, 6))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (None, "w1 w2 w3")], "item_id bigint, text string"
    )
    found = decontaminate.match_items(docs, table, block_items=block).collect()
    assert {(r["doc_id"], m["item"]) for r in found for m in r["matches"]} == expected
    clean = decontaminate.decontaminate(docs, table)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len({d for d, _ in expected})
    assert decontaminate.match_items(odd, table).count() == odd.count()
    assert decontaminate.match_items(odd.where("false"), table).collect() == []
    assert decontaminate.decontaminate(odd, table.where("false")).count() == odd.count()
