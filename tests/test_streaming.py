import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from eventsift import analyze_events
from eventsift.operators.behaviour import source_windows
from eventsift.plans.analysis import load_models, score_events
from eventsift.streaming.batches import BatchTable
from eventsift.streaming.retraining import load_latest, retrain
from eventsift.streaming.scoring import (
    CarriedEvents,
    StreamScorer,
    parse_batch,
    read_counts,
    read_line_stream,
    read_scores,
    sliding_counts,
    store_counts,
)

START = dt.datetime(2026, 6, 1, 8, 0, 0)


def _lines(first, n):
    out = []
    for i in range(first, first + n):
        t = START + dt.timedelta(seconds=7 * i)
        out.append(f"{t:%Y-%m-%d %H:%M:%S} {'ERROR' if i % 13 == 0 else 'INFO'} svc-{i % 3}: request {i % 5} completed")
    return out


def test_stream_scores_equal_one_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for j in range(3):
        (logs / f"part{j}.log").write_text("\n".join(_lines(40 * j, 40)) + "\n")
    raw = spark.read.text(str(logs)).select("value", F.lit("f").alias("file"), F.lit(0).alias("block_start"))
    events = parse_batch(raw)
    run = analyze_events(events)
    run.save(str(tmp_path / "model"))
    features, detector = load_models(spark, str(tmp_path / "model"))
    expected = {(r.timestamp, r.source): r.anomaly_score for r in score_events(events, features, detector).collect()}

    scorer = StreamScorer(features, detector, str(tmp_path / "out"), CarriedEvents(str(tmp_path / "state")))
    # One file per trigger, oldest first.
    for j in range(3):
        os.utime(logs / f"part{j}.log", (1_700_000_000 + j, 1_700_000_000 + j))
    stream = read_line_stream(spark, str(logs), glob="*.log", max_files=1)
    query = scorer.start_on(stream, str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = read_scores(spark, str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() == 3
    got = {(r.timestamp, r.source): r.anomaly_score for r in out.collect()}
    assert got == expected
    assert out.select("event_id").distinct().count() == 120
    # only the versions that a restart may need are left, and no table of a batch
    assert sorted(d for d in os.listdir(tmp_path / "state") if d.startswith("batch")) == ["batch_id=1", "batch_id=2"]


def test_carried_events_answer_windows(spark, tmp_path):
    schema = "event_id long, timestamp timestamp_ntz, source string"
    rows = [(i, START + dt.timedelta(seconds=20 * i), f"s{i % 2}") for i in range(30)]
    at_once = source_windows(spark.createDataFrame(rows, schema)).collect()
    whole = {r.timestamp: (r.gap_seconds, r.trailing_count) for r in at_once}
    carried = CarriedEvents(str(tmp_path / "state"), delay_seconds=0)
    got = {}
    for b in range(5):
        batch = spark.createDataFrame(rows[6 * b : 6 * b + 6], schema)
        old = carried.before(spark, b)
        for r in source_windows(carried.extend(batch, old)).filter("event_id >= 0").collect():
            got[r.timestamp] = (r.gap_seconds, r.trailing_count)
        carried.store(batch, old, b)
    assert got == whole


def test_an_event_ahead_of_the_clock_does_not_empty_the_windows(spark, tmp_path):
    schema = "event_id long, timestamp timestamp_ntz, source string"
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    rows = [(i, now + dt.timedelta(seconds=i), "s") for i in range(6)]
    carried = CarriedEvents(str(tmp_path / "state"))
    first = [*rows[:5], (99, dt.datetime(2099, 1, 1), "other")]
    carried.store(spark.createDataFrame(first, schema), carried.before(spark, 0), 0)
    batch = carried.extend(spark.createDataFrame(rows[5:], schema), carried.before(spark, 1))
    (row,) = source_windows(batch).filter("event_id >= 0").collect()
    assert row.trailing_count == 6


def test_sliding_counts(spark, tmp_path):
    rows = [(START + dt.timedelta(seconds=30 * i), "s") for i in range(100)]
    spark.createDataFrame(rows, "timestamp timestamp_ntz, source string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("timestamp timestamp_ntz, source string").parquet(str(tmp_path / "in"))
    counts = sliding_counts(stream, delay="1 minute")
    store_counts(counts, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    found = {r.window_end: r.events for r in read_counts(spark, str(tmp_path / "out")).collect()}
    assert found[START + dt.timedelta(seconds=600)] == 2
    # every event is in six windows, the last ones too
    assert sum(found.values()) == 600 and max(found) == rows[-1][0] + dt.timedelta(seconds=60)


def test_retrain_versions(spark, tmp_path):
    raw = spark.createDataFrame([(v, "f", 0) for v in _lines(0, 120)], "value string, file string, block_start long")
    events = parse_batch(raw)
    for minutes in (8, 12):
        retrain(events, START + dt.timedelta(minutes=minutes), dt.timedelta(minutes=6), str(tmp_path / "m"))
    features, detector = load_latest(spark, str(tmp_path / "m"))
    assert features.n_rows == sum(
        1 for i in range(120) if dt.timedelta(minutes=6) < dt.timedelta(seconds=7 * i) <= dt.timedelta(minutes=12)
    )
    assert score_events(events, features, detector).count() == 120


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    table = BatchTable(str(tmp_path / "table"))
    with pytest.raises(FileNotFoundError):
        table.read(spark)

    def rows(n):
        return spark.range(n).withColumn("day", F.col("id") % 2)

    table.write(rows(4), 0, ("day",))
    commit = BatchTable._commit
    monkeypatch.setattr(BatchTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):  # written, not committed
        table.write(rows(100), 1, ("day",))
    assert table.batches(spark) == [0] and table.read(spark).count() == 4
    monkeypatch.setattr(BatchTable, "_commit", commit)
    table.write(rows(5), 1, ("day",))
    table.write(rows(6), 1, ("day",))  # repeated
    assert table.batches(spark) == [0, 1] and table.read(spark).count() == 10
    reader = table.read(spark)
    table.write(rows(0), 2, ("day",))
    table.write(rows(1), 3, ("day",))
    table.compact(spark, ("day",), files=1)
    assert table.batches(spark) == [0, 1, 2, 3] and reader.count() == 10
    assert sorted(r.id for r in table.read(spark).collect()) == sorted([*range(4), *range(6), 0])
    before = len(os.listdir(tmp_path / "table" / "data"))
    table.clean(spark)
    table.compact(spark)
    left = os.listdir(tmp_path / "table" / "data")
    assert len(left) < before and table.read(spark).count() == 11
    assert len([n for n in os.listdir(tmp_path / "table" / "manifests") if n.isdigit()]) == 2


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    table = BatchTable(str(tmp_path / "table"))
    table.write(spark.range(1), 0)
    seen = table._latest(spark)
    table.write(spark.range(2), 1)
    monkeypatch.setattr(BatchTable, "_latest", lambda *_: seen)
    with pytest.raises(RuntimeError):
        table.write(spark.range(3), 1)
