"""A corpus from raw documents to token ids: quality, lines, near duplicates, benchmark items, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before kept, written as
Parquet and read again. All but the last return the columns of their input. ``run`` applies the stages
to the documents of ``sf_dir``. Rows with a null key or text, repeated rows and empty tables pass through as the
operators define; rows of equal key count as one document. Tables that a stage stores on its way are removed
when it is done, and its input when the next one has it.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsift.llm import bpe, decontaminate, lines, quality_model, simhash
from eventsift.llm.common import keeping_columns, table
from eventsift.llm.queries import MIN_PROBABILITY, graded
from eventsift.storage import discard, scratch, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least of grade 1 (good, toxic or not) with some probability; the rest goes."""
    model = quality_model.learn(docs, graded(table(spark, sf_dir, "labels")))
    added = ["expected_grade", "tails", "kept"]
    return keeping_columns(
        docs, added, lambda d: quality_model.select(d, model, probability=MIN_PROBABILITY).where("kept")
    )


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five sites or more share with an earlier document."""
    cleaned = keeping_columns(docs, ["n_lines_removed"], lines.dedup_lines)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group whose fingerprints of three-word shingles link at two bits."""
    found = simhash.near_duplicates(docs)
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, copied or edited."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every document."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            docs = settled(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, stored)
        stored = own
    encoded = settled(spark, partial(STAGES[-1][1], spark, docs, sf_dir), "encoded")
    discard(spark, stored)
    return encoded


#: Hash features, SimHash, alignment and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
