import datetime as dt
import os
import random

from eventsift.operators.behaviour import source_windows
from eventsift.streaming.batches import BatchTable
from eventsift.streaming.late import LateWindows, read_windows

START = dt.datetime(2024, 6, 1, 8, 0, 0)
SCHEMA = "event_id long, timestamp timestamp_ntz, source string"


def _event(i, seconds, source):
    return (i, None if seconds is None else START + dt.timedelta(seconds=seconds), source)


def _answers(df):
    return {r.event_id: (r.gap_seconds, r.trailing_count) for r in df.collect()}


def test_any_order_within_the_delay_gives_the_batch_answers(spark, tmp_path):
    rng = random.Random(5)
    rows = [_event(i, 4 * (i // 2), "hot" if i % 3 else f"s{i % 4}") for i in range(240)]  # pairs of equal times
    rows += [_event(900, None, "hot"), _event(901, 12, None)]
    arrival = sorted(rows, key=lambda r: ((r[1] or START) - START).total_seconds() + rng.uniform(0, 100))
    # few rows a group are allowed, so the source with most events goes through running totals
    late = LateWindows(str(tmp_path / "out"), str(tmp_path / "state"), delay_seconds=100, max_group_rows=40)
    for b in range(4):
        late(spark.createDataFrame(arrival[61 * b : 61 * b + 61], SCHEMA), b)
    late(spark.createDataFrame(arrival[183:], SCHEMA), 3)  # the newest batch once more, as after a crash
    got = read_windows(spark, str(tmp_path / "out"))
    assert _answers(got) == _answers(source_windows(spark.createDataFrame(rows, SCHEMA)))
    assert got.filter("corrections > 0").count() > 0 and got.filter("not complete").isEmpty()
    told = BatchTable(str(tmp_path / "out")).read(spark)
    assert told.groupBy("event_id", "batch_id").count().filter("count > 1").isEmpty()
    assert sorted(d for d in os.listdir(tmp_path / "state")) == ["batch_id=2", "batch_id=3"]


def test_events_beyond_the_delay_leave_closed_answers(spark, tmp_path):
    late = LateWindows(str(tmp_path / "out"), str(tmp_path / "state"), delay_seconds=30)
    late(spark.createDataFrame([], SCHEMA), 0)
    late(spark.createDataFrame([_event(1, 0, "a"), _event(2, 10, "a"), _event(3, 300, "a")], SCHEMA), 1)
    late(spark.createDataFrame([_event(4, 5, "a"), _event(5, 290, "a")], SCHEMA), 2)
    got = {r.event_id: r for r in read_windows(spark, str(tmp_path / "out")).collect()}
    assert (got[2].gap_seconds, got[2].trailing_count, got[2].corrections) == (10.0, 2, 0)
    assert not got[4].complete and got[5].complete
    assert (got[5].gap_seconds, got[5].trailing_count) == (280.0, 1)
    assert (got[3].gap_seconds, got[3].trailing_count, got[3].corrections) == (10.0, 2, 1)
