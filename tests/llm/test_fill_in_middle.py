import hashlib

import pytest

from eventsift.llm import fill_in_middle


def expected(key, text):
    """Form, sizes and output of one document, straight from the rule."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk", [3, 4096])
@pytest.mark.parametrize("name", ["odd", "documents", "marks"])
def test_outputs_and_restored_texts(request, spark, name, chunk):
    if name == "marks":
        texts = ["a<P>b", "<P", ">", "<<", "x<S", "<M>", "P><S", "<P<S>", "ab<", "𝒳é" * 50, "<" * 40, None]
        docs = spark.createDataFrame([(i, t) for i in range(30) for t in texts], "doc_id bigint, text string")
    else:
        docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    if chunk == 3:
        docs = docs.where("coalesce(length(text), 0) < 5000")
        rows = [r for r in rows if len(r["text"] or "") < 5000]
    want = [(r["doc_id"], *expected(r["doc_id"], r["text"])) for r in rows]
    texts = fill_in_middle.outputs(docs, chunk=chunk)
    assert sorted(map(repr, map(tuple, texts.collect()))) == sorted(map(repr, want))
    got = fill_in_middle.digests(docs, chunk=chunk).collect()
    full = [(*w[:5], sha(w[5]), sha(r["text"] or "")) for w, r in zip(want, rows, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, full))
    back = fill_in_middle.restore(texts, chunk=chunk).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in back) == sorted((repr(r["doc_id"]), r["text"] or "") for r in rows)


def test_outputs_of_another_form_and_empty_tables(spark, odd):
    rows = [(1, "psm", "<P>a<S>b<M>c"), (2, "spm", "<P>a<S>b<M>c"), (3, "psm", "abc"), (4, None, "a"), (5, "plain", None)]
    table = spark.createDataFrame(rows, "doc_id int, form string, output string")
    got = {r["doc_id"]: r["text"] for r in fill_in_middle.restore(table).collect()}
    assert got == {1: "acb", 2: None, 3: None, 4: None, 5: None}
    none = odd.where("false")
    assert fill_in_middle.digests(none).collect() == [] and fill_in_middle.outputs(none).collect() == []


def test_repeated_rows_travel_once(odd):
    many = odd.where("doc_id = 1").crossJoin(odd.sparkSession.range(500).select("id"))
    assert fill_in_middle.pieces(many.coalesce(1)).where("place = -1").count() == 1
    assert fill_in_middle.digests(many).count() == 500
