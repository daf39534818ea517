"""CSV exports as all-string records."""

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventsift.sources.quoted import block_states, read_blocks, read_records

# Cells read as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Name of the column with records that have too many cells; headers cannot hold the control character.
SURPLUS = "surplus\x1f"

# Below this size a file is read by one task anyway, so quoted line breaks cost nothing.
ONE_TASK_BYTES = 128 * 1024 * 1024


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    glob: str | None = None,
    max_bytes: int | None = None,
    same_header: bool = False,
    multi_line: bool | None = None,
    wanted: Column | None = None,
    one_task_bytes: int = ONE_TASK_BYTES,
) -> list[DataFrame]:
    """One DataFrame per distinct header row: its columns as text, plus ``event_id, file, block_start``
    and ``surplus``, the whole text of records with more cells than the header (else null).

    Folders are read to any depth; ``wanted`` (over ``file``) selects files.
    ``same_header`` skips the look at every file's first row; a file with another header then fails. Files up to
    ``one_task_bytes`` are read by one task each, larger ones by blocks. ``multi_line=None`` looks whether cells of the larger
    ones span lines; True and False say so. Lines of files that are cut in such a way end at line feeds, with or without a
    carriage return ahead.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = (
        reader.format("binaryFile")
        .load(paths)
        .select(F.col("path").alias("file"), "length")
        .filter("length > 0")
    )
    if wanted is not None:
        files = files.filter(wanted)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    big = F.col("length") > one_task_bytes
    # Both lists name files only; Spark's own file index holds the same names on the driver.
    sized = files.withColumn("big", big).collect()
    if not sized:
        return []
    names = [r["file"] for r in sized]
    headers = dict.fromkeys(names, "") if same_header else _first_rows(spark, names)
    large = [r["file"] for r in sized if r["big"]]
    whole = dict.fromkeys(names, multi_line is not False)
    whole |= dict.fromkeys(large, False)
    # Names that Spark reads itself, as the header row goes on in the next line, stay in one task.
    cut = [n for n in large if multi_line is not False and n in headers and _column_names(headers[n])]
    states, spanning = None, set()
    if cut:
        states = block_states(read_blocks(spark, cut))
        chosen = states if multi_line else states.filter("spans")
        spanning = {_plain(r["file"]) for r in chosen.select("file").distinct().collect()}
    whole |= {n: True for n in set(large) - set(cut) if multi_line is not False}
    groups: dict[tuple[str, bool, bool], list[str]] = {}
    for name in names:
        if name in headers:
            groups.setdefault((headers[name], whole[name], _plain(name) in spanning), []).append(name)
    return [
        _cut_group(spark, group, header, states) if spans else _read_group(spark, group, header, one_task)
        for (header, one_task, spans), group in groups.items()
    ]


def _read_group(spark: SparkSession, names: list[str], header: str, one_task: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", one_task).option("escape", '"')
    columns = _column_names(header)
    record = _unused("_record", columns)
    if columns:
        fields = [T.StructField(c, T.StringType()) for c in [*columns, record]]
        reader = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", record)
    else:
        reader = reader.option("enforceSchema", False)
    records = reader.csv(names)
    surplus = F.lit(None).cast("string")
    if columns:
        # The reader needs one real column besides the record, so the first one takes part.
        present = F.coalesce(F.length(quoted_name(columns[0])), F.lit(0)) >= 0
        surplus = F.when(_too_many_cells(F.col(record), columns) & present, F.col(record))
    return records.select(
        *[F.col(quoted_name(c)).cast(T.StringType()).alias(c) for c in records.columns if c != record],
        surplus.alias(SURPLUS),
        F.monotonically_increasing_id().alias("event_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def _cut_group(spark: SparkSession, names: list[str], header: str, states: DataFrame) -> DataFrame:
    """As ``_read_group`` for large files with cells that span lines: records are cut by many tasks, then parsed."""
    columns = _column_names(header)
    record = _unused("_record", columns)
    options = {"escape": '"', "columnNameOfCorruptRecord": record}
    cells = F.from_csv("text", ", ".join(f"{quoted_name(c)} string" for c in [*columns, record]), options)
    found = read_records(spark, names, states, "text").select("file", "block_start", cells.alias("cells"))
    broken = F.col("cells").getField(record)
    return found.select(
        *[F.col("cells").getField(c).alias(c) for c in columns],
        F.when(_too_many_cells(broken, columns), broken).alias(SURPLUS),
        F.monotonically_increasing_id().alias("event_id"),
        "file",
        "block_start",
    )


def _too_many_cells(record: Column, columns: list[str]) -> Column:
    """Whether a record that the reader marks has surplus cells; it marks those with too few as well, which are padded."""
    unquoted = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1 > len(columns)


def quoted_name(column: str) -> str:
    """``column`` as a name for Spark, whatever characters it holds."""
    return f"`{column.replace('`', '``')}`"


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _column_names(header: str) -> list[str]:
    """Names of a header row; a repeated one, whatever its case, is numbered so that the first counts.

    Empty when the row is unknown or goes on in the next line; Spark then reads the names itself.
    """
    if not header or header.count('"') % 2:
        return []
    names, seen = [], set()
    for i, name in enumerate(next(csv.reader([header]))):
        name, n = name or f"unnamed {i}", 0
        while (unique := f"{name}.{n}" if n else name).lower() in seen:
            n += 1
        seen.add(unique.lower())
        names.append(unique)
    return names


def _first_rows(spark: SparkSession, names: list[str]) -> dict[str, str]:
    """File name to its first non-empty line."""
    lines = spark.read.text(names).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    first = lines.filter("value != ''").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    by_path = {_plain(r["file"]): r["header"].lstrip("\ufeff") for r in first.collect()}
    return {n: by_path[_plain(n)] for n in names if _plain(n) in by_path}


def _plain(path: str) -> str:
    """Paths come as ``file:/x`` or ``file:///x`` depending on the column."""
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon else path
