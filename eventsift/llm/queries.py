"""Named queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsift.llm import bpe, byte_bpe, decontaminate, fill_in_middle, language_id, lines, quality_model, quality_rules
from eventsift.llm import simhash, substring, token_counts, toxicity, whitening
from eventsift.llm.common import table
from eventsift.storage import settled


def fold(key: str, folds: int) -> Column:
    """The fold of a row: CRC-32 of its key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.learn_dictionaries(docs.where(fold("doc_id", 4) != 2))
    found = language_id.identify(docs, dictionaries, keep=["doc_id"])
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "accepted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    return settled(spark, lambda: bpe.encode(docs, path, with_ids=False))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1")
    found = settled(spark, lambda: quality_rules.judge(docs, quality_rules.likelihood_ratios(docs, trusted), keep=["doc_id"]))
    contract = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*contract, "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(spark, lambda: simhash.near_duplicates(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, sf_dir, "documents"))
    none_left = F.col("n_removed") == F.col("n_words")
    kept = F.when(none_left, F.sha2(F.lit(""), 256)).when(F.col("n_removed") == 0, F.col("digest"))
    return found.select("doc_id", "n_words", "n_removed", kept.otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.match_items(docs, items, keep=["doc_id"])
    return found.select("doc_id", F.inline("matches")).withColumnRenamed("item", "item_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines_removed", "text")


#: Documents go only if good quality is less likely than this.
MIN_PROBABILITY = 0.25


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two label columns: 0 poor, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ratings = table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels"))
    model = quality_model.learn(docs, ratings.where(fold("doc_id", 4) != 2))
    found = quality_model.select(docs, model, probability=MIN_PROBABILITY, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "expected_grade",
        F.element_at("tails", 1).alias("p_grade_1"),
        F.element_at("tails", 2).alias("p_grade_2"),
        "kept",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 3) != 1))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained())).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    decoded = byte_bpe.decode(encoded, path)
    digests = (F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("ids", "decoded"))
    return decoded.select("doc_id", "n_tokens", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_substring": op5_substring,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_model": op8_quality_model,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op5_substring": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS run
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50)
        ), firsts AS (
            SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
            FROM windows JOIN firsts USING (run) WHERE doc_id > first_id
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
        ), kept AS (
            SELECT p.doc_id, count(g.place) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY p.place) FILTER (WHERE g.place IS NULL), '') AS left_words
            FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id
        )
        SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(left_words, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
    """,
    "op7_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents
        ), trimmed AS (
            SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM parts
        ), shared AS (
            SELECT bare, min(doc_id) AS first_id FROM trimmed WHERE bare <> ''
            GROUP BY bare HAVING count(DISTINCT coalesce('=' || source, '')) >= 5
        ), marked AS (
            SELECT t.doc_id, t.line, t.pos, s.bare IS NOT NULL AND t.doc_id <> s.first_id AS gone
            FROM trimmed t LEFT JOIN shared s ON t.bare = s.bare
        )
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_lines_removed,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY doc_id
    """,
    "op12_fill_in_middle": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
            FROM documents
        ), drawn AS (
            SELECT *, CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (n + 1) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                        OR CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), parts AS (
            SELECT *, substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, abs(a - b)) AS middle,
                substr(text, greatest(a, b) + 1) AS suffix
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
}
