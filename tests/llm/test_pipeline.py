import corpus_pipeline
from eventsift.llm import decontaminate, lines, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        before, rows = {r["doc_id"]: r for r in docs.collect()}, after.collect()
        kept = {r["doc_id"] for r in rows}
        if name == "line dedup":
            assert kept == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()} == {r["doc_id"]: r["text"] for r in rows}
        elif name == "near duplicates":
            found = simhash.near_duplicates(docs).collect()
            assert kept == {r["component_id"] for r in found}
        elif name == "benchmark decontamination":
            items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            found = decontaminate.match_items(docs, items).where("size(matches) > 0").collect()
            assert kept == set(before) - {r["doc_id"] for r in found}
        else:
            poor = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
            gone = set(before) - kept
            assert len(gone & poor) >= 0.8 * len(poor & set(before))
        docs = after
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == {r["doc_id"] for r in docs.collect()}


def test_odd_rows_pass_through(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
        if name != "BPE encoding":
            assert docs.columns == odd.columns
            assert {(r["kept"], r["matches"]) for r in docs.where("doc_id = 6").collect()} == {("7", "7")}
    assert {r["doc_id"] for r in docs.collect()} >= {1, 6, 7, 8, 9}
    docs = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []
