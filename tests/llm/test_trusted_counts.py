from eventsift.llm import quality_rules


def test_all_trusted_documents_count(spark):
    # 20,500 trusted texts of one word of their own, 500 others of one word
    docs = spark.range(21_000).selectExpr("id AS doc_id", "if(id < 20500, concat('w', id), 'poor') AS text")
    ratios = quality_rules.likelihood_ratios(docs, docs.where("doc_id < 20500"), size=1 << 15)
    trusted = docs.where("doc_id < 20500")
    scores = quality_rules.judge(trusted, ratios).select("score").collect()
    # a few share a bucket with the other word
    assert sum(r["score"] > 0 for r in scores) >= 0.995 * len(scores)


def test_only_rows_that_may_be_trusted_move(spark):
    docs = spark.range(4000).selectExpr("if(id % 10 = 3, null, id) AS doc_id", "concat('w', id) AS text")
    keys = spark.range(0, 800).selectExpr("id AS _key").where("_key % 10 <> 3")
    rows = docs.withColumnRenamed("doc_id", "_key").withColumn("may", quality_rules._marked(keys, "_key"))
    may = {r["_key"] for r in rows.where("may").collect()}
    trusted = {r["_key"] for r in keys.collect()}
    assert rows.where("may is null").isEmpty()
    assert trusted <= may and None not in may and len(may - trusted) < 400
    full = rows.select("_key", quality_rules._marked(keys, "_key", most=64).alias("may"))
    assert trusted <= {r["_key"] for r in full.where("may").collect()}


def test_counts_are_those_of_a_plain_join(spark):
    # keys repeat and are null on both sides, and have another type
    docs = spark.sql("SELECT if(id % 7 = 0, null, id % 50) AS doc_id, concat('a b w', id % 13, ' c', id) AS text FROM range(300)")
    trusted = spark.sql("SELECT cast(if(id % 5 = 0, null, id % 20) AS int) AS doc_id FROM range(60)")
    keys = {r["doc_id"] for r in trusted.collect()} - {None}
    marked = docs.withColumn("t", docs["doc_id"].isin(*keys))
    size = 1 << 10
    got = quality_rules.likelihood_ratios(docs, trusted, size=size).first()["ratios"]
    own = marked.where("t").select("doc_id").distinct()
    unique = marked.selectExpr("if(coalesce(t, false), 1, 0) AS doc_id", "text")
    expected = quality_rules.likelihood_ratios(unique, spark.sql("SELECT 1 AS doc_id"), size=size).first()["ratios"]
    assert own.count() == len(keys) and got == expected
