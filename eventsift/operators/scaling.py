"""Standard scaling with population deviation."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: spacing of doubles at 1, for the constant-column rule below.
_EPS = 2.0**-52


@dataclass
class Scaler:
    """Mean and divisor per column."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return (F.col(column) - F.lit(self.mean[i])) / F.lit(self.scale[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregate over the named columns; a constant column gets divisor 1."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(F.count("*").alias("n"), *stats).first()
    mean, scale = [], []
    for c in columns:
        m, s = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        noise = row["n"] * _EPS * s * s + (row["n"] * m * _EPS) ** 2
        mean.append(m)
        scale.append(1.0 if s * s <= noise else s)
    return Scaler(list(columns), mean, scale)
