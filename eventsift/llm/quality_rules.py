"""Text statistics and a target-against-corpus likelihood test, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.storage import materialise

_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 8


def words(text: Column) -> Column:
    """Words between runs of ASCII white space; an empty array for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _neighbours(hashes: str, step: int) -> Column:
    """One hash for every two elements ``step`` apart."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """_row with the ``columns`` of ``docs``, _hashes of all words, _pairs of neighbours, and the statistics."""
    source = docs.select(
        F.struct(*columns).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_text"), words(docs[text]).alias("_words")
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    source = source.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", _SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    ).drop("_text", "_words")
    source = source.select(
        "*",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _neighbours("_hashes", 1).alias("_pairs"),
    ).drop("_lines")
    # a text without equal runs of four words has no equal runs of eight
    source = source.withColumn("_fours", _neighbours("_pairs", 2))
    eights = F.when(F.size("_fours") > F.size(F.array_distinct("_fours")), _neighbours("_fours", 4))
    source = source.withColumn("_windows", eights).drop("_fours")
    # sorted by hash, equal windows are neighbours; only texts with such windows are sorted at all
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    ordered = F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    source = source.withColumn("_ordered", ordered).drop("_windows")
    twins = F.filter(
        "_ordered",
        lambda e, i: ((i > 0) & (F.get("_ordered", i - 1)["h"] == e["h"])) | F.coalesce(F.get("_ordered", i + 1)["h"] == e["h"], F.lit(False)),
    )
    source = source.withColumn("_at", F.array_sort(F.transform(twins, lambda e: e["i"]))).drop("_ordered")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-_WINDOW).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(_WINDOW), i - acc["last"])).cast("bigint").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return source.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_at")


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if not given) of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null text has no words and no lines. Columns of these names are replaced. Windows of eight words
    are compared by a 64-bit hash within their text.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in _STATISTICS]
    return _measured(docs, text, columns).select("_row.*", *_STATISTICS)


def _bucket(hashed: Column, size: int) -> Column:
    return hashed.bitwiseAND(F.lit(size - 1)).cast("int")


_MARKS = 1 << 26  # bits at most: 8 MB, and one key in ten is taken for another at 7 million keys


def _marked(keys: DataFrame, key: str, most: int = _MARKS) -> Column:
    """Whether the key column ``_key`` may be among ``keys``: false for no key that is, true for few that are not.

    One bit for each hash, about sixteen a key and at most ``most`` in all, a power of two and 64 or more.
    """
    size = min(max(64, 1 << (16 * keys.count()).bit_length()), most)
    place = F.xxhash64(key).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = keys.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    filled = keys.sparkSession.range(size // 64).join(found, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda s: s["bits"])
    bits = materialise(filled.coalesce(1).agg(listed.alias("marks")), "marks").select("marks").scalar()
    here = F.xxhash64("_key").bitwiseAND(F.lit(size - 1))
    word = F.get(bits, F.shiftright(here, 6).cast("int"))
    return F.col("_key").isNotNull() & (F.getbit(word, here.bitwiseAND(F.lit(63)).cast("int")) == 1)


def likelihood_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = 1 << 15,
    smoothing: float = 1.0,
) -> DataFrame:
    """One row, ratios: for ``size`` (a power of two) buckets of words, then of neighbouring pairs, the log of its share among trusted documents over its share in the corpus.

    Both sides are counted over all of ``docs``: the corpus on every row, the trusted target on every row whose
    key is in ``trusted``. Shares are smoothed by ``smoothing`` counts per bucket.
    """
    kind = docs.schema[key].dataType
    picked = materialise(trusted.select(F.col(key).try_cast(kind).alias("_key")).where("_key is not null").distinct(), "trusted")
    # only rows whose key may be trusted move, of any number in the same way; the others are counted where they are read
    source = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    maybe = _marked(picked, "_key")
    without = source.where(~maybe).select(F.lit(None).cast("int").alias("_trusted"), "_text")
    joined = source.where(maybe).join(picked.withColumn("_trusted", F.lit(1)).hint("shuffle_hash"), "_key", "left")
    source = joined.select("_trusted", "_text").unionAll(without)
    source = source.select("_trusted", words(F.col("_text")).alias("_words"))
    source = source.select("_trusted", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    following = F.slice("_hashes", 2, F.greatest(F.size("_hashes") - 1, F.lit(0)))  # the last word has none
    terms = source.select("_trusted", F.inline(F.arrays_zip(F.col("_hashes").alias("a"), following.alias("b"))))
    found = F.array(_bucket(F.col("a"), size), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"), size) + size))
    counts = (
        terms.select("_trusted", F.explode(found).alias("bucket")).where("bucket is not null")
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    )
    counts = materialise(counts, "buckets")
    kinds = counts.groupBy((F.col("bucket") >= size).alias("pair")).agg(F.sum("raw").alias("r"), F.sum("target").alias("t"))
    shares = (
        docs.sparkSession.range(2 * size).select(F.col("id").cast("int").alias("bucket"), (F.col("id") >= size).alias("pair"))
        .join(F.broadcast(counts), "bucket", "left").join(F.broadcast(kinds), "pair", "left")
        .select(
            "bucket",
            (
                F.log((F.coalesce("target", F.lit(0)) + smoothing) / (F.coalesce("t", F.lit(0)) + smoothing * size))
                - F.log((F.coalesce("raw", F.lit(0)) + smoothing) / (F.coalesce("r", F.lit(0)) + smoothing * size))
            ).alias("ratio"),
        )
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda s: s["ratio"])
    return materialise(shares.coalesce(1).agg(listed.alias("ratios")), "ratios")


def judge(
    docs: DataFrame,
    ratios: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    size: int = 1 << 15,
    threshold: float = -0.1,
    min_words: int = 20,
    max_repeat_share: int = 30,
) -> DataFrame:
    """``statistics`` with score, base_failed and kept, for every row; columns of these names are replaced.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_share`` percent of them in repeated
    windows. score: mean log ratio of the words and word pairs of the whole text (null without words).
    kept: not base_failed and score at least ``threshold``; the same text is always judged the same.
    """
    added = (*_STATISTICS, "score", "base_failed", "kept")
    columns = [c for c in (docs.columns if keep is None else keep) if c not in added]
    table = ratios.select("ratios").scalar()
    found = _measured(docs, text, columns).withColumn("_ratios", table)
    single = F.aggregate("_hashes", F.lit(0.0), lambda acc, h: acc + F.get("_ratios", _bucket(h, size)))
    pairs = F.aggregate("_pairs", F.lit(0.0), lambda acc, h: acc + F.get("_ratios", _bucket(h, size) + size))
    terms = F.size("_hashes") + F.size("_pairs")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    found = found.select(
        "_row",
        *_STATISTICS,
        F.when(terms > 0, (single + pairs) / terms).alias("score"),
        failed.alias("base_failed"),
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return found.select("_row.*", *_STATISTICS, "score", "base_failed", kept.alias("kept"))
