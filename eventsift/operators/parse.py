"""Lines and CSV records to the event table."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventsift.functions.lines import LineFormat, line_formats
from eventsift.functions.times import csv_time
from eventsift.schema import EVENT_FIELDS, EVENT_SCHEMA
from eventsift.sources.csv import MISSING, ONE_TASK_BYTES, SURPLUS, quoted_name, read_csv
from eventsift.sources.guard import CSV_NAME, TEXT_NAME, list_input, normal_path
from eventsift.sources.text import LINE_ORDER, read_lines
from eventsift.storage import materialise

SAMPLE_LINES = 25
_BROADCAST_FILES = 500_000
_SALTS = 32

# Header names understood for each event field.
ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date"],
    "level": ["level", "loglevel", "severity"],
    "source": ["source", "host", "service", "component"],
    "message": ["message", "msg", "log", "text"],
}


@dataclass(frozen=True)
class ParseResult:
    """Parsed events; statistics are computed on demand. ``rejected`` lists the files that were not read."""

    events: DataFrame
    rejected: DataFrame | None = None

    def stats(self) -> DataFrame:
        """Per file: total and parsed lines, format, parse rate, empty messages."""
        return parse_stats(self.events, "file")

    def totals(self) -> DataFrame:
        """The same as one row over everything; format ``empty`` without any line."""
        return parse_stats(self.events)


def parse_stats(events: DataFrame, *by: str) -> DataFrame:
    total, parsed = F.count("*"), F.count_if("parsed")
    lowest, highest = F.min("fmt"), F.max("fmt")
    fmt = F.when(total == 0, "empty").when(lowest == highest, lowest).otherwise("mixed")
    return events.groupBy(*by).agg(
        total.alias("total_lines"),
        parsed.alias("parsed_lines"),
        fmt.alias("fmt_detected"),
        F.when(total == 0, 0.0).otherwise(parsed / total).alias("parse_rate"),
        F.count_if(F.col("message") == "").alias("empty_messages"),
    )


def format_votes(lines: DataFrame, formats: list[LineFormat] | None = None) -> DataFrame:
    """Per file: ``votes_<format>`` over its first 25 lines and the winning ``fmt``.

    The rank filter is applied per task before the shuffle, so at most 25 lines per file and
    task move. A file read by very many tasks is first reduced in parts.
    """
    formats = formats or line_formats()
    order = [c for c in LINE_ORDER if c in lines.columns and c != "file"]
    head = lines.withColumn("_part", F.pmod(F.hash(order[0]), F.lit(_SALTS)))
    for group in (["file", "_part"], ["file"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        head = head.withColumn("_n", rank).filter(F.col("_n") <= SAMPLE_LINES)
    votes = head.groupBy("file").agg(
        *[F.count_if(f.matches(F.col("value"))).alias(f"votes_{f.name}") for f in formats]
    )
    return votes.withColumn("fmt", _winner({f.name: F.col(f"votes_{f.name}") for f in formats}))


def _winner(votes: dict[str, Column]) -> Column:
    # The first format with the most votes; also the first one when nothing matches.
    best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
    chain = F.when(F.lit(False), "")
    for name, count in votes.items():
        chain = chain.when(count == best, name)
    return chain


def parse_lines(
    lines: DataFrame,
    formats: list[LineFormat] | None = None,
    detect: str = "file",
    fmt: str | None = None,
) -> DataFrame:
    """``event_id, value, file, ...`` lines to events; lines of another layout keep their text.

    ``detect='file'`` votes one format per file, ``detect='line'`` takes the first that matches
    each line, ``fmt`` names the format of all lines and saves the vote.
    """
    formats = formats or line_formats()
    if fmt is not None:
        formats = [f for f in formats if f.name == fmt]
        marked = lines.withColumn("fmt", F.lit(fmt))
    elif detect == "line":
        chain = F.when(F.lit(False), "")
        for f in formats:
            chain = chain.when(f.matches(F.col("value")), f.name)
        marked = lines.withColumn("fmt", chain.otherwise(formats[0].name))
    else:
        marked = _with_voted_format(lines, formats)

    groups = expected = fields = None
    for f in formats:
        here = F.col("fmt") == f.name
        found, size, built = f.captured(F.col("value")), F.lit(f.groups), f.fields_of("_groups")
        groups = F.when(here, found) if groups is None else groups.when(here, found)
        expected = F.when(here, size) if expected is None else expected.when(here, size)
        fields = F.when(here, built) if fields is None else fields.when(here, built)
    parsed = F.size("_groups") == expected
    return (
        marked.withColumn("_groups", groups)
        .withColumn("_fields", F.when(parsed, fields))
        .select(
            "event_id",
            *[F.col(f"_fields.{c}").alias(c) for c in EVENT_FIELDS[:3]],
            F.when(parsed, F.col("_fields.message")).otherwise(F.col("value")).alias("message"),
            parsed.alias("parsed"),
            "fmt",
            *[c for c in lines.columns if c not in ("event_id", "value")],
        )
    )


def _with_voted_format(lines: DataFrame, formats: list[LineFormat]) -> DataFrame:
    voted = materialise(format_votes(lines, formats).select("file", "fmt"), "formats")
    winners = [r[0] for r in voted.select("fmt").distinct().collect()]
    if len(winners) <= 1:
        return lines.withColumn("fmt", F.lit(winners[0] if winners else formats[0].name))
    if voted.count() <= _BROADCAST_FILES:
        return lines.join(F.broadcast(voted), "file")
    # Too many files to broadcast; salting keeps one huge file from becoming one task.
    salted = voted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (
        lines.withColumn("_salt", F.pmod(F.hash("event_id"), F.lit(_SALTS)))
        .join(salted, ["file", "_salt"])
        .drop("_salt")
    )


def canonicalise(records: DataFrame, epoch_unit: str = "s", keep: list[str] | None = None) -> DataFrame:
    """All-string records with any header to the event columns.

    Header names are trimmed and lower-cased; of two names for one field the first wins, and a
    field nobody provides becomes null before the defaults apply. A record with more cells than its header
    keeps its whole text as message and does not count as parsed.
    """
    keep = keep if keep is not None else [c for c in ("event_id", "file", "block_start") if c in records.columns]
    cells: dict[str, Column] = {}
    for name in records.columns:
        if name in keep or name == SURPLUS:
            continue
        for field, known in ALIASES.items():
            if name.strip().lower() in known and field not in cells:
                cell = F.col(quoted_name(name)).cast("string")
                cells[field] = F.when(~cell.isin(*MISSING), cell)
    cell = {f: cells.get(f, F.lit(None).cast("string")) for f in EVENT_FIELDS}
    surplus = F.col(f"`{SURPLUS}`") if SURPLUS in records.columns else F.lit(None).cast("string")
    return records.select(
        *[c for c in keep if c == "event_id"],
        csv_time(cell["timestamp"], epoch_unit).alias("timestamp"),
        F.upper(F.coalesce(cell["level"], F.lit("INFO"))).alias("level"),
        F.coalesce(cell["source"], F.lit("unknown")).alias("source"),
        F.coalesce(surplus, cell["message"], F.lit("")).alias("message"),
        surplus.isNull().alias("parsed"),
        F.lit("csv").alias("fmt"),
        *[c for c in keep if c != "event_id"],
    )


def parse_text_log(
    spark: SparkSession,
    paths: str | list[str],
    detect: str = "file",
    fmt: str | None = None,
    syslog_year: int | None = None,
    formats: list[LineFormat] | None = None,
    glob: str | None = None,
    max_bytes: int | None = None,
    wanted: Column | None = None,
) -> ParseResult:
    """Parse text log files of the known line formats."""
    lines = read_lines(spark, paths, glob, max_bytes, wanted)
    return ParseResult(parse_lines(lines, formats or line_formats(syslog_year), detect, fmt))


def parse_csv_log(
    spark: SparkSession,
    paths: str | list[str],
    epoch_unit: str = "s",
    glob: str | None = None,
    max_bytes: int | None = None,
    same_header: bool = False,
    multi_line: bool | None = None,
    wanted: Column | None = None,
    one_task_bytes: int = ONE_TASK_BYTES,
) -> ParseResult:
    """Parse CSV exports; every record counts as parsed unless it has more cells than the header."""
    parts = read_csv(spark, paths, glob, max_bytes, same_header, multi_line, wanted, one_task_bytes)
    if not parts:
        return ParseResult(spark.createDataFrame([], EVENT_SCHEMA))
    events = None
    for part in parts:
        records = canonicalise(part, epoch_unit).drop("event_id")
        events = records if events is None else events.unionByName(records)
    # Numbered after the union: ids of separate reads would collide.
    numbered = events.withColumn("event_id", F.monotonically_increasing_id())
    return ParseResult(numbered.select("event_id", *[c for c in numbered.columns if c != "event_id"]))


def parse_log_file(spark: SparkSession, paths: str | list[str], **options) -> ParseResult:
    """Parse files and folders of any depth: ``.csv`` names as CSV, ``.log`` and ``.txt`` (rotated and compressed
    ones too) as text, and any other file that ``paths`` itself names as text.

    Every file is decided on alone; files that are not read are in ``rejected`` with the reason.
    """
    text_opts = {k: v for k, v in options.items() if k in ("detect", "fmt", "syslog_year", "formats", "max_bytes")}
    csv_opts = {k: v for k, v in options.items() if k in ("epoch_unit", "max_bytes", "same_header", "multi_line", "one_task_bytes")}
    listed = list_input(spark, paths, options.get("max_bytes"))
    rejected = listed.filter("reason is not null").select("path", "length", "reason")
    read = listed.filter("reason is null")
    kinds = {r["kind"] for r in read.select("kind").distinct().collect()}
    named = [r["path"] for r in read.filter("named and kind = 'text'").select(normal_path(F.col("path")).alias("path")).collect()]
    text, records = None, None
    if "text" in kinds or not kinds:
        wanted = F.lower("file").rlike(TEXT_NAME) | normal_path(F.col("file")).isin(named)
        text = parse_text_log(spark, paths, wanted=wanted & ~F.lower("file").rlike(CSV_NAME), **text_opts).events
    if "csv" in kinds:
        records = parse_csv_log(spark, paths, wanted=F.lower("file").rlike(CSV_NAME), **csv_opts).events
    if text is None or records is None:
        return ParseResult(records if text is None else text, rejected)
    both = text.withColumn("event_id", F.col("event_id") * 2).unionByName(
        records.withColumn("event_id", F.col("event_id") * 2 + 1)
    )
    return ParseResult(both, rejected)
