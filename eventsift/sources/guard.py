"""Input checks before a run."""

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.sources.text import LINE_ORDER
from eventsift.storage import materialise

_log = logging.getLogger("eventsift")

# Compressed files count by the extension before these.
_PACKED = r"(\.(gz|bz2|deflate|lz4|snappy|zst))?$"
TEXT_NAME = r"\.(log|txt)([.-]\d[\d.-]*)?" + _PACKED
CSV_NAME = r"\.csv" + _PACKED


class UnsupportedInputError(ValueError):
    """A file named in the input is of a kind that runs do not take."""


def normal_path(path: Column) -> Column:
    """Paths come as ``file:/x`` or ``file:///x`` depending on the column."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def _resolved(spark: SparkSession, path: str) -> str:
    """``path`` as listings have it: with its file system, and relative names under the working folder of the session."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()
    return re.sub(r"^(\w+):/+", r"\1:/", full)


def _named(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``key``: the paths that the input itself names; those of folders and patterns match no file."""
    names = {_resolved(spark, p) for p in ([paths] if isinstance(paths, str) else paths)}
    return spark.createDataFrame([(n,) for n in sorted(names)], "key string")


def list_input(spark: SparkSession, paths: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """``path, length, named, kind, reason`` of every file, folders included to any depth.

    kind: ``csv`` by name; ``text`` for ``.log`` and ``.txt`` (rotated or compressed ones too) and for every other
    file that ``paths`` itself names. Each file is judged alone, whatever else is there; reason tells why a
    file is not read (no kind, empty, or above ``max_bytes``, which is off by default: large files are
    split). Only listings are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    # Scans skip empty files; the listing, which Spark keeps on the driver anyway, has them.
    listed = spark.createDataFrame([(n,) for n in files.inputFiles()], "listed string")
    sized = files.select(normal_path(F.col("_metadata.file_path")).alias("key"), F.col("length").alias("_length"))
    listed = listed.withColumn("key", normal_path(F.col("listed"))).join(sized, "key", "left")
    # listings write some characters of a name as %XX, the input may have either
    plain = F.coalesce(F.try_url_decode(F.replace("key", F.lit("+"), F.lit("%2B"))), F.col("key"))
    named = _named(spark, paths).withColumn("named", F.lit(True))
    found = (
        listed.withColumn("plain", plain)
        .join(named, "key", "left")
        .join(named.select(F.col("key").alias("plain"), F.lit(True).alias("_named")), "plain", "left")
        .select("listed", "_length", (F.col("named").isNotNull() | F.col("_named").isNotNull()).alias("named"))
    )
    found = found.select(F.col("listed").alias("path"), F.coalesce("_length", F.lit(0)).alias("length"), "named")
    name = F.lower("path")
    kind = F.when(name.rlike(CSV_NAME), "csv").when(name.rlike(TEXT_NAME) | F.col("named"), "text")
    too_big = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    found = found.withColumn("kind", kind)
    reason = (
        F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported file type '"), _extension(), F.lit("'")))
        .when(F.col("length") == 0, "empty file")
        .when(too_big, f"larger than {max_bytes} bytes")
    )
    return found.withColumn("reason", reason)


def _extension() -> Column:
    return F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))


def validate_input(spark: SparkSession, paths: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """``path, length, reason`` of every file; ``reason`` is null for accepted ones.

    Stricter than reading: a named file needs a supported extension too.
    """
    listed = list_input(spark, paths, max_bytes)
    name = F.lower("path")
    odd = ~(name.rlike(CSV_NAME) | name.rlike(TEXT_NAME))
    unsupported = F.concat(F.lit("unsupported file type '"), _extension(), F.lit("'"))
    return listed.select("path", "length", F.when(odd, unsupported).otherwise(F.col("reason")).alias("reason"))


def require_supported(spark: SparkSession, paths: str | list[str]) -> None:
    """Raise if ``paths`` names a file of an unsupported type."""
    name = F.lower("path")
    odd = list_input(spark, paths).where("named").where(~(name.rlike(CSV_NAME) | name.rlike(TEXT_NAME)))
    first = odd.select("path").orderBy("path").first()
    if first:
        raise UnsupportedInputError(f"unsupported file type: {first['path']}")


def enforce_row_limit(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The first ``max_rows`` events in file order; all of them by default.

    Nothing is sorted: rows are counted by file and block, blocks up to the limit are kept whole, and of the one block that
    holds the limit the rows of smallest ``event_id``. Events without files go by ``event_id``, a unique whole number.
    """
    if max_rows is None:
        return events
    _log.warning("keeping the first %s events in file order", max_rows)
    block = [c for c in LINE_ORDER[:-1] if c in events.columns]
    if not block:
        return _smallest_ids(events, max_rows)
    sizes = materialise(events.groupBy(*block).agg(F.count("*").alias("_rows")), "blocks")
    ahead = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block of a file
    needed = sizes.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).where(F.col("_ahead") < max_rows)
    needed = materialise(needed, "blocks")
    cut = needed.where(F.col("_ahead") + F.col("_rows") > max_rows).first()
    whole = needed.where(F.col("_ahead") + F.col("_rows") <= max_rows).select(*block)
    kept = events.join(whole, block, "left_semi").select(*events.columns)
    if cut is None:
        return kept
    inside = events
    for c in block:
        inside = inside.where(F.col(c).eqNullSafe(F.lit(cut[c])))
    return kept.unionByName(_smallest_ids(inside, max_rows - cut["_ahead"]))


def _smallest_ids(events: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` events of smallest ``event_id``, found by counting ids in ever smaller ranges: four scans at most."""
    ids = events.select(F.col("event_id").cast("bigint").alias("v"))
    low, high, n = ids.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if n <= rows:
        return events
    if rows <= 0:
        return events.where(F.lit(False))
    wanted = rows
    while low < high:
        width = (high - low) // 65_536 + 1
        bins = ids.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("b"))
        for row in bins.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
            if wanted <= row["n"]:
                break
            wanted -= row["n"]
        low, high = row["low"], row["high"]
        if wanted == row["n"]:
            low = high
    return events.where(F.col("event_id") <= F.lit(low))
