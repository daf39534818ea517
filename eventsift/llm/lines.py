"""Removal of lines that many sites share, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.storage import materialise

def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def shared_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    site: str = "source",
    min_sites: int = 5,
    log_size: int = 10,
    band: float = 0.3,
) -> DataFrame:
    """(line_hash, first_key) of the lines of at least ``min_sites`` distinct sites.

    Each line has a HyperLogLog sketch of its sites; sketches merge in partial aggregation, so that a line
    in a third of all documents is no burden to one task. An estimate farther from ``min_sites`` than ``band``
    (nine standard errors at ``log_size`` 10) decides by itself; the lines in between get exact distinct counts.
    Null sites count as one site of their own; null and blank lines are no lines. first_key is the least key with
    the line. Lines are compared without outer white space, by 64-bit hash.
    """
    lines = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("site"),
        F.col(key).alias("key"),
        F.explode(F.split(text, "\n")).alias("line"),
    ).select(_trimmed(F.col("line")).alias("line"), "site", "key").where("line <> ''").select(F.xxhash64("line").alias("line_hash"), "site", "key")
    spread = lines.groupBy("line_hash").agg(
        F.hll_sketch_agg("site", F.lit(log_size)).alias("sketch"), F.min("key").alias("first_key")
    ).select("line_hash", "first_key", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialise(spread.where(F.col("sites") >= min_sites * (1 - band)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("line_hash", "first_key")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line_hash", "first_key")
    exact = (
        lines.select("line_hash", "site").join(near, "line_hash").distinct()
        .groupBy("line_hash").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sure.unionAll(near.join(exact.select("line_hash"), "line_hash"))


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    site: str = "source",
    min_sites: int = 5,
    log_size: int = 10,
    band: float = 0.3,
) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, and n_lines_removed.

    A line shared by ``min_sites`` sites or more stays in the document of least key that has it and goes
    everywhere else, with its line break. Rows of equal key and text are treated alike; rows with a null key lose every
    shared line (none is theirs first). Null text stays null, all rows stay; a text may become empty.
    n_lines_removed is replaced if present.
    """
    columns = [c for c in docs.columns if c != "n_lines_removed"]
    shared = materialise(shared_lines(docs, text, key, site, min_sites, log_size, band), "shared")
    placed = docs.select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.posexplode(F.split(text, "\n")).alias("_at", "_line")
    ).select("_key", "_hash", "_at", F.xxhash64(_trimmed(F.col("_line"))).alias("line_hash"))
    removed = (
        placed.join(shared, "line_hash")
        .where(F.col("_key").isNull() | (F.col("_key") != F.col("first_key")))
        .groupBy("_key", "_hash").agg(F.collect_set("_at").alias("_removed"))
    )
    removed = materialise(removed, "removed")
    source = docs.select(F.struct(*columns).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    joined = source.alias("d").join(
        removed.alias("r"), F.col("d._key").eqNullSafe(F.col("r._key")) & (F.col("d._hash") == F.col("r._hash")), "left"
    )
    whole = F.col("_row").getField(text)
    joined = joined.select("_row", "_removed", F.when(F.col("_removed").isNotNull(), F.split(whole, "\n")).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")
    cleaned = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        *[
            F.when(F.col("_removed").isNull(), whole).otherwise(cleaned).alias(c) if c == text else F.col("_row").getField(c).alias(c)
            for c in columns
        ],
        F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("n_lines_removed"),
    )
