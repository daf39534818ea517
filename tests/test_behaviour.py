import datetime as dt
import random

import pytest

from eventsift.operators.behaviour import source_windows
from eventsift.operators.ordered import event_positions
from eventsift.operators.quantiles import exact_quantiles

START = dt.datetime(2026, 6, 1, 7, 30)


def _events(spark, seed, n=600, step=40, resolution=1.0):
    """Three sources, one holding most rows; repeated times; some rows without time or source."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = START + dt.timedelta(seconds=round(rng.uniform(0, step * 60) / resolution) * resolution)
        s = rng.choice(["hot", "hot", "hot", "b", "c"])
        roll = rng.random()
        if roll < 0.05:
            t = None
        elif roll < 0.1:
            s = None
        if s == "c" and t is not None:
            t += dt.timedelta(hours=rng.choice([0, 5, 30]))
        rows.append((i * 7919 % 10007, t, s, f"m{i}"))
    return spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, source string, message string")


def _expected(rows, window):
    out = {}
    for r in rows:
        out[r.event_id] = (None, 0.0)
    for s in {r.source for r in rows if r.source is not None}:
        mine = sorted((r.timestamp, r.event_id) for r in rows if r.source == s and r.timestamp is not None)
        for i, (t, e) in enumerate(mine):
            gap = (t - mine[i - 1][0]).total_seconds() if i else None
            n = sum(1 for u, _ in mine[: i + 1] if u > t - dt.timedelta(seconds=window))
            out[e] = (gap, float(n))
    return out


@pytest.mark.parametrize(
    "window, limit, resolution",
    [(60, 10**9, 0.25), (5400, 10**9, 600), (60, 150, 0.25), (5400, 150, 600), (60, 20, 600), (5400, 20, 0.25), (60, 1, 0.25)],
)
def test_windows_match_brute_force(spark, monkeypatch, window, limit, resolution):
    monkeypatch.setattr("eventsift.operators.ordered._MIN_TASK_ROWS", 60)
    events = _events(spark, 3, resolution=resolution)
    got = source_windows(events, window, max_group_rows=limit).collect()
    rows = events.collect()
    assert len(got) == len(rows)
    assert {r.message for r in got} == {r.message for r in rows}
    assert {r.event_id: (r.gap_seconds, r.trailing_count) for r in got} == _expected(rows, window)


def test_event_positions(spark, monkeypatch):
    monkeypatch.setattr("eventsift.operators.ordered._MIN_TASK_ROWS", 60)
    events = _events(spark, 5)
    got = event_positions(events, ["event_id"], rows_per_task=50).collect()
    assert [r.event_index for r in sorted(got, key=lambda r: r.event_id)] == list(range(600))


@pytest.mark.parametrize("limit", [10**6, 40, 3])
def test_exact_quantiles(spark, limit):
    rng = random.Random(1)
    values = [rng.expovariate(1) ** 5 for _ in range(500)] + [2.5] * 200 + [-1e12, 1e12]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.05, 0.4, 0.5, 0.95, 1.0]
    import numpy as np

    got = exact_quantiles(df, "x", probs, in_memory_rows=limit)
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
