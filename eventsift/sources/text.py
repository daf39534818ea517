"""Text log files as lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsift.functions.lines import EXTRA_LINE_ENDS, not_blank

# Glob patterns are case-sensitive, hence the classes.
LOG_GLOB = "*.{[lL][oO][gG],[tT][xX][tT]}"
CSV_GLOB = "*.[cC][sS][vV]"

# File order of lines and records: event_id grows along a block of a file.
LINE_ORDER = ["file", "block_start", "event_id"]


def split_lines(text: Column) -> Column:
    """Array of the lines in ``text``, at every line end that Unicode knows."""
    ends = EXTRA_LINE_ENDS.replace("[", r"[\n\r", 1)
    return F.split(text, rf"\r\n|{ends}")


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    glob: str | None = None,
    max_bytes: int | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Non-blank lines: ``event_id, value, file, block_start``.

    Folders are read to any depth. ``wanted`` (over ``file``) selects files; others are not opened.

    Bytes that are not UTF-8 become U+FFFD. Large files are read in blocks by many tasks;
    ``LINE_ORDER`` restores the order inside a file.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = with_file_fields(reader.text(paths))
    if wanted is not None:
        raw = raw.filter(wanted)
    if max_bytes is not None:
        raw = raw.filter(F.col("file_size") <= max_bytes)
    return to_lines(raw).select(F.monotonically_increasing_id().alias("event_id"), "value", "file", "block_start")


def with_file_fields(raw: DataFrame) -> DataFrame:
    """Text rows with the file they come from; works on batch and streaming reads."""
    return raw.select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def to_lines(raw: DataFrame) -> DataFrame:
    """Split at the line ends the reader leaves in, and drop blank lines."""
    pieces = F.when(F.col("value").rlike(EXTRA_LINE_ENDS), F.split("value", EXTRA_LINE_ENDS)).otherwise(
        F.array("value")
    )
    return raw.select(F.explode(pieces).alias("value"), "file", "block_start").filter(not_blank(F.col("value")))
