"""Raw scores to the 0-100 scale and to flags."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsift.operators.quantiles import exact_quantiles


@dataclass
class ScoreScale:
    """Bounds of the raw score and the value above which a row is flagged."""

    low: float
    high: float
    threshold: float

    def anomaly_score(self, raw: Column) -> Column:
        """0 to 100 with two decimals (half to even); 0 when all raw scores are equal."""
        span = self.high - self.low
        if span < 1e-9:
            return F.lit(0.0)
        share = (raw - F.lit(self.low)) / F.lit(span) * 100
        # Scores outside fitted bounds stay on the scale.
        return F.bround(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)), 2)

    def is_anomaly(self, raw: Column) -> Column:
        return raw > F.lit(self.threshold)

    def attach(self, scored: DataFrame, raw: str) -> DataFrame:
        c = F.col(raw)
        return scored.withColumns({"anomaly_score": self.anomaly_score(c), "is_anomaly": self.is_anomaly(c)})


def thresholds(scored: DataFrame, raw: str, contamination: list[float]) -> list[float]:
    """Per share: the raw score that this share of the rows exceeds."""
    # Quantiles of the negated score, as lower means more unusual there.
    negated = scored.select((-F.col(raw)).alias("v"))
    return [-q for q in exact_quantiles(negated, "v", contamination)]


def score_bounds(scored: DataFrame, raw: str) -> tuple[float, float]:
    return tuple(scored.agg(F.min(raw), F.max(raw)).first())


def fit_scale(scored: DataFrame, raw: str, contamination: float) -> ScoreScale:
    low, high = score_bounds(scored, raw)
    return ScoreScale(low, high, thresholds(scored, raw, [contamination])[0])


def contamination_sweep(scored: DataFrame, raw: str, shares: list[float]) -> DataFrame:
    """``contamination, flagged, total``: one fit, one counting pass for all shares."""
    cuts = thresholds(scored, raw, shares)
    counts = scored.agg(
        F.count("*").alias("total"), *[F.count_if(F.col(raw) > F.lit(t)).alias(f"n{i}") for i, t in enumerate(cuts)]
    )
    rows = F.array(
        *[F.struct(F.lit(float(s)).alias("contamination"), F.col(f"n{i}").alias("flagged")) for i, s in enumerate(shares)]
    )
    return counts.select(F.inline(rows), "total")
