"""Windows of a stream whose events arrive out of order: answers already given are corrected."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from eventsift.operators.behaviour import source_windows
from eventsift.schema import ROLLING_WINDOW_SECONDS
from eventsift.storage import discard, materialise, scratch
from eventsift.streaming.batches import BatchTable

_STATE = (
    "event_id bigint, timestamp timestamp_ntz, source string, old_gap double, old_count bigint, closed_before timestamp_ntz"
)


@dataclass
class LateWindows:
    """``foreachBatch`` function: gap and trailing count of every event, corrected while late events can still come.

    The input has ``event_id`` (unique), ``timestamp`` and ``source``. An event at or after the watermark (latest time
    seen, at most the present, minus ``delay_seconds``) is open: an event that arrives later may lie before it. Open
    events are carried with the answer they have got, together with the window before them and the last earlier event
    of each source; a batch answers its own events and again those open ones whose gap or count it changes. Input whose
    events are late by no more than the delay so ends with the answers of one batch run, in any order of arrival.

    An event later than that is answered from what is still carried and marked by ``complete = false``; closed answers stay.
    Events without source or time are answered at once and not carried. What is carried is a table of the events of
    the last ``delay_seconds + window_seconds``, and it is computed per source and hour like a batch, so a source that
    holds most of it is many groups. Versions older than the one a restart needs are removed.
    """

    output: str
    state: str
    window_seconds: int = ROLLING_WINDOW_SECONDS
    delay_seconds: int = 600
    max_group_rows: int = 2_000_000

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch() as stored:
            known = self._before(spark, batch_id)
            closed = known.agg(F.max("closed_before")).first()[0]
            events = batch.select("event_id", "timestamp", "source").withColumn("answered", F.lit(False))
            both = events.unionByName(
                known.drop("closed_before").withColumn("answered", F.lit(True)), allowMissingColumns=True
            )
            both = materialise(both, "open-events")
            answers = materialise(source_windows(both, self.window_seconds, self.max_group_rows), "answers")
            is_open = F.lit(True) if closed is None else F.col("timestamp") >= F.lit(closed).cast("timestamp_ntz")
            same = F.col("gap_seconds").eqNullSafe(F.col("old_gap")) & (F.col("trailing_count") == F.col("old_count"))
            told = answers.filter(~F.col("answered") | (is_open & ~same)).select(
                "event_id",
                "timestamp",
                "source",
                "gap_seconds",
                "trailing_count",
                F.coalesce(is_open, F.lit(True)).alias("complete"),
                F.lit(batch_id).cast("bigint").alias("batch_id"),
            )
            BatchTable(self.output).write(told, batch_id)
            self._store(answers, closed, batch_id)
        discard(spark, stored)

    def _before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], _STATE)
        return spark.read.schema(_STATE).parquet(f"{self.state}/batch_id={batch_id - 1}")

    def _store(self, answers: DataFrame, closed: dt.datetime | None, batch_id: int) -> None:
        spark = answers.sparkSession
        timed = answers.filter("source is not null and timestamp is not null").select(
            "event_id",
            "timestamp",
            "source",
            F.col("gap_seconds").cast("double").alias("old_gap"),
            F.col("trailing_count").cast("bigint").alias("old_count"),
        )
        # In UTC, as all event times.
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
        latest = timed.agg(F.least(F.max("timestamp"), now)).first()[0]
        if latest is not None:
            passed = latest - dt.timedelta(seconds=self.delay_seconds)
            closed = passed if closed is None else max(closed, passed)
            reach = closed - dt.timedelta(seconds=self.window_seconds)
            recent = F.col("timestamp") >= F.lit(reach).cast("timestamp_ntz")
            # Only the time of a closed event counts; of equal times any event will do.
            last = timed.filter(~recent).groupBy("source").agg(
                F.max("timestamp").alias("timestamp"), F.max_by("event_id", "timestamp").alias("event_id")
            )
            timed = timed.filter(recent).unionByName(last, allowMissingColumns=True)
        kept = timed.withColumn("closed_before", F.lit(closed).cast("timestamp_ntz"))
        kept.write.mode("overwrite").parquet(f"{self.state}/batch_id={batch_id}")
        if batch_id > 1:  # a repeated batch reads the version before its own
            discard(spark, [f"{self.state}/batch_id={batch_id - 2}"])

    def start_on(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)


def read_windows(spark: SparkSession, output: str) -> DataFrame:
    """The newest answer to every event, and how often it was corrected."""
    answer = F.struct("timestamp", "source", "gap_seconds", "trailing_count", "complete")
    newest = BatchTable(output).read(spark).groupBy("event_id").agg(
        F.max_by(answer, "batch_id").alias("a"), (F.count("*") - 1).alias("corrections")
    )
    return newest.select("event_id", "a.*", "corrections")
