"""Exact quantiles of any number of rows."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINS = 2048


def exact_quantiles(df: DataFrame, column: str, probs: list[float], in_memory_rows: int = 2_000_000) -> list[float]:
    """Quantiles with linear interpolation, nulls ignored; NaN-free input expected.

    Up to ``in_memory_rows`` values the built-in aggregate does it. Beyond, all wanted order statistics are
    bracketed together: one scan counts equal-width bins within every bracket, a map-side aggregate of at most 2048 rows for
    each, and the bins that hold the ranks are the next brackets. Once they hold few enough values, one
    last scan reads the ranks. So the number of scans does not depend on the number of quantiles.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probs)
    if n <= in_memory_rows:
        exact = values.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs]))).first()[0]
        return list(exact)
    spots = [p * (n - 1) for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    found = order_statistics(values, ranks, n, lo, hi, in_memory_rows)
    out = []
    for s in spots:
        low, high = found[math.floor(s)], found[math.ceil(s)]
        out.append(low + (high - low) * (s - math.floor(s)))
    return out


def order_statistics(
    values: DataFrame, ranks: list[int], n: int, lo: float, hi: float, in_memory_rows: int
) -> dict[int, float]:
    """For each rank the value of column ``v`` with so many ahead of it, of ``n`` values from ``lo`` to ``hi``."""
    # rank: smallest and largest value of its bracket, values ahead of the rank within it, values in it
    at = {r: (lo, hi, r, n) for r in ranks}
    while True:
        brackets = {b[:2]: b[3] for b in at.values() if b[0] < b[1]}
        if sum(brackets.values()) <= in_memory_rows:
            break
        bins = _count_bins(values, sorted(brackets))
        for rank, (low, high, ahead, _) in at.items():
            if low < high:
                for row in bins[low, high]:
                    if ahead < row["n"]:
                        break
                    ahead -= row["n"]
                at[rank] = (row["lo"], row["hi"], ahead, row["n"])
    open_ranks = [r for r, b in at.items() if b[0] < b[1]]
    found = {r: b[0] for r, b in at.items()}
    if open_ranks:
        wanted = [F.expr(_ranked(*at[r])).alias(f"r{r}") for r in open_ranks]
        row = values.agg(*wanted).first()
        found |= {r: row[f"r{r}"] for r in open_ranks}
    return found


def _ranked(lo: float, hi: float, ahead: int, n: int) -> str:
    """SQL of the value with ``ahead`` others before it among the ``n`` from ``lo`` to ``hi``."""
    share = f"CAST('{(ahead + 0.5) / n!r}' AS DOUBLE)"
    inside = f"v BETWEEN CAST('{lo!r}' AS DOUBLE) AND CAST('{hi!r}' AS DOUBLE)"
    return f"percentile_disc({share}) WITHIN GROUP (ORDER BY v) FILTER (WHERE {inside})"


def _bin_of(lo: float, hi: float) -> Column:
    width = (hi - lo) / _BINS
    if width == 0 or math.isinf(width):
        return (F.col("v") > lo / 2 + hi / 2).cast("bigint")
    return F.least(F.floor((F.col("v") - lo) / width), F.lit(_BINS - 1))


def _count_bins(values: DataFrame, brackets: list[tuple[float, float]]) -> dict[tuple[float, float], list]:
    """For each of the brackets, which do not overlap: rows, smallest and largest value of its non-empty bins, rising."""
    which, bin_of = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for i, (lo, hi) in enumerate(brackets):
        inside = F.col("v").between(lo, hi)
        which, bin_of = F.when(inside, i).otherwise(which), F.when(inside, _bin_of(lo, hi)).otherwise(bin_of)
    counted = (
        values.withColumns({"i": which, "b": bin_of})
        .filter("i is not null")
        .groupBy("i", "b")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("i", "b")
        .collect()
    )
    found: dict[tuple[float, float], list] = {b: [] for b in brackets}
    for row in counted:
        found[brackets[row["i"]]].append(row)
    return found
