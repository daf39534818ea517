"""Scoring a stream of log lines with saved models.

Each micro-batch is an ordinary DataFrame, so it goes through the same per-source windows as a
batch run (and shares their handling of dominating sources). What earlier batches contribute is
a small table per batch: the recent events and the last event of every source.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from eventsift.operators.behaviour import source_windows
from eventsift.operators.ordered import event_positions
from eventsift.operators.parse import parse_lines
from eventsift.plans.detector import AnomalyDetector
from eventsift.plans.features import FeatureModel
from eventsift.plans.analysis import score_events
from eventsift.schema import ROLLING_WINDOW_SECONDS
from eventsift.sources.text import to_lines, with_file_fields
from eventsift.storage import discard, materialise, scratch
from eventsift.streaming.batches import BatchTable


def read_line_stream(
    spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Raw lines of text files as they appear under ``path``, at most ``max_files`` per batch."""
    reader = spark.readStream.option("pathGlobFilter", glob) if glob else spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_file_fields(reader.text(path))


_BATCH_BITS = 36  # event numbers within a micro-batch


def numbered(events: DataFrame, batch_id: int) -> DataFrame:
    """Stored ``events`` with ids that no other micro-batch gives: the batch number above the row's position."""
    placed = event_positions(events, ["event_id"], "_position")
    return placed.withColumn("event_id", F.lit(batch_id << _BATCH_BITS) + F.col("_position")).drop("_position")


def parse_batch(raw: DataFrame, **parse_options) -> DataFrame:
    """A micro-batch of raw lines to events; the layout is found per line unless ``fmt`` is given."""
    lines = to_lines(raw).withColumn("event_id", F.monotonically_increasing_id())
    options = parse_options if "fmt" in parse_options else {"detect": "line", **parse_options}
    return parse_lines(lines, **options)


@dataclass
class CarriedEvents:
    """Recent events of earlier micro-batches, one version per batch under ``path``.

    Kept are events newer than the watermark (latest time seen minus ``delay_seconds``) minus the
    window, and the last event of every source. Later batches so see every earlier event inside
    their windows unless it was later than the delay allows. An event dated ahead of the clock does
    not move the watermark past it. Versions older than the one a restart needs are removed.
    """

    path: str
    window_seconds: int = ROLLING_WINDOW_SECONDS
    delay_seconds: int = 600

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        schema = "source string, timestamp timestamp_ntz"
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/batch_id={batch_id - 1}")

    def extend(self, batch: DataFrame, carried: DataFrame) -> DataFrame:
        """``batch`` plus the carried events, marked by a negative ``event_id``."""
        old = carried.withColumn("event_id", -1 - F.monotonically_increasing_id())
        return batch.unionByName(old, allowMissingColumns=True)

    def store(self, batch: DataFrame, carried: DataFrame, batch_id: int) -> None:
        known = carried.unionByName(
            batch.filter("source is not null and timestamp is not null").select("source", "timestamp")
        )
        # In UTC, as all event times.
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
        latest = known.agg(F.least(F.max("timestamp"), now)).first()[0]
        keep = known
        if latest is not None:
            reach = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.window_seconds + self.delay_seconds))
            recent = F.col("timestamp") > F.lit(latest).cast("timestamp_ntz") - reach
            last = known.filter(~recent).groupBy("source").agg(F.max("timestamp").alias("timestamp"))
            keep = known.filter(recent).unionByName(last)
        keep.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        if batch_id > 1:  # a repeated batch reads the version before its own
            discard(batch.sparkSession, [f"{self.path}/batch_id={batch_id - 2}"])


@dataclass
class StreamWindows:
    """``foreachBatch`` function: the exact gap and trailing count of every event of a stream.

    The input has ``event_id`` (not negative, unique), ``timestamp`` and ``source``; results land in
    ``output/batch_id=N``. An event later than the carried events allow gets what is still known.
    """

    output: str
    carried: CarriedEvents
    max_group_rows: int = 2_000_000

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with scratch() as stored:
            events = materialise(batch, "batch")
            carried = self.carried.before(batch.sparkSession, batch_id)
            windows = source_windows(
                self.carried.extend(events, carried), self.carried.window_seconds, self.max_group_rows
            )
            windows.filter("event_id >= 0").write.mode("overwrite").parquet(f"{self.output}/batch_id={batch_id}")
            self.carried.store(events, carried, batch_id)
        discard(batch.sparkSession, stored)

    def start_on(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)


@dataclass
class StreamScorer:
    """``foreachBatch`` function: parse, build features, score, append to a result table.

    Results are a ``BatchTable`` under ``output``, partitioned by date: a repeated batch replaces its own rows, so a
    restart neither loses nor doubles any, and ``read_scores`` sees whole batches only.
    """

    features: FeatureModel
    detector: AnomalyDetector
    output: str
    carried: CarriedEvents
    parse_options: dict | None = None

    def __call__(self, raw: DataFrame, batch_id: int) -> None:
        with scratch() as stored:
            events = parse_batch(raw, **(self.parse_options or {})) if "value" in raw.columns else raw
            events = materialise(events, "batch")
            if "value" in raw.columns:
                events = materialise(numbered(events, batch_id), "batch")
            carried = self.carried.before(raw.sparkSession, batch_id)
            scored = score_events(self.carried.extend(events, carried), self.features, self.detector)
            own = scored.filter("event_id >= 0").withColumn("date", F.to_date("timestamp"))
            own = own.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            BatchTable(self.output).write(own, batch_id, ("date",))
            self.carried.store(events, carried, batch_id)
        discard(raw.sparkSession, stored)

    def start_on(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A configured writer; the caller sets the trigger and starts it."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)


def read_scores(spark: SparkSession, output: str) -> DataFrame:
    """The results of all batches that a ``StreamScorer`` has completed."""
    return BatchTable(output).read(spark)


def sliding_counts(
    stream: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """``source, window_start, window_end, events`` over sliding event-time windows.

    The aggregate is combined before the shuffle, so a busy source costs one row per task and
    window. Counts at window ends are what the exact trailing count is between them.
    """
    timed = stream.filter("source is not null").select("source", F.col("timestamp").cast("timestamp").alias("_ts"))
    return (
        timed.withWatermark("_ts", delay)
        .groupBy("source", F.window("_ts", window, slide).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(
            "source",
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "events",
        )
    )


def store_counts(counts: DataFrame, output: str, checkpoint: str) -> DataStreamWriter:
    """Write every change of ``sliding_counts`` to ``output``, windows that are still open included."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_counts(spark: SparkSession, output: str) -> DataFrame:
    """The latest count of every window that ``store_counts`` has written."""
    latest = F.max_by("events", "batch_id").alias("events")
    return spark.read.parquet(output).groupBy("source", "window_start", "window_end").agg(latest)
