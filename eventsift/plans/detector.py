"""Isolation forest detector with a fitted threshold and score scale."""

from pyspark.sql import DataFrame

from eventsift.operators.forest import Forest, fit_forest
from eventsift.operators.scores import ScoreScale, fit_scale, score_bounds
from eventsift.plans import model_store
from eventsift.schema import (
    DEFAULT_CONTAMINATION,
    DEFAULT_TREES,
    MAX_SAMPLES,
    NUMERIC_FEATURES,
    RANDOM_SEED,
    TEXT_PREFIX,
)
from eventsift.storage import materialise

_RAW = "raw_score"


def feature_columns(df: DataFrame) -> list[str]:
    """The matrix columns of a table from ``build_feature_matrix``."""
    return [c for c in df.columns if c in NUMERIC_FEATURES or c.startswith(TEXT_PREFIX)]


class AnomalyDetector:
    """Fit on a feature table with unique ``id_col`` values, then score this or other tables."""

    def __init__(
        self,
        contamination: float = DEFAULT_CONTAMINATION,
        n_estimators: int = DEFAULT_TREES,
        max_samples: int = MAX_SAMPLES,
        seed: int = RANDOM_SEED,
        id_col: str = "event_id",
    ):
        self.contamination = contamination
        self.n_estimators = n_estimators
        self.max_samples = max_samples
        self.seed = seed
        self.id_col = id_col
        self.forest: Forest | None = None
        self.scale: ScoreScale | None = None

    def fit(self, table: DataFrame, features: list[str] | None = None) -> "AnomalyDetector":
        self._fit(table, features)
        return self

    def fit_score(
        self, table: DataFrame, features: list[str] | None = None, keep: list[str] | None = None
    ) -> DataFrame:
        """Fit and score the same table, carrying the ``keep`` columns; raw scores are computed once."""
        scored = self._fit(table, features, table.columns if keep is None else keep)
        return self.scale.attach(scored, _RAW).drop(_RAW)

    def _fit(self, table: DataFrame, features: list[str] | None, keep: list[str] | None = None) -> DataFrame:
        features = features or feature_columns(table)
        n_rows = table.count()
        if n_rows == 0:
            raise ValueError("cannot fit on a table without rows")
        self.forest = fit_forest(
            table, features, n_rows, self.n_estimators, self.max_samples, self.seed, self.id_col
        )
        raw = self.forest.raw_score().alias(_RAW)
        scored = materialise(table.select(*(keep or []), raw), "scores")
        self.scale = fit_scale(scored, _RAW, self.contamination)
        return scored

    def raw_scores(self, table: DataFrame) -> DataFrame:
        """``table`` with the raw forest score in ``raw_score``."""
        self._check_fitted()
        return table.withColumn(_RAW, self.forest.raw_score())

    def score(self, table: DataFrame, bounds: str = "batch") -> DataFrame:
        """Add ``anomaly_score`` (0-100, higher is more unusual) and ``is_anomaly``.

        ``bounds='batch'`` rescales over the rows of ``table``; ``'fitted'`` uses the bounds of
        the fit, so scores of different batches compare and nothing is computed ahead.
        """
        self._check_fitted()
        if bounds == "fitted":
            return self.scale.attach(self.raw_scores(table), _RAW).drop(_RAW)
        scored = materialise(self.raw_scores(table), "scores")
        low, high = score_bounds(scored, _RAW)
        if low is None:
            low = high = 0.0
        return ScoreScale(low, high, self.scale.threshold).attach(scored, _RAW).drop(_RAW)

    def save(self, path: str, spark=None) -> None:
        self._check_fitted()
        model_store.save_detector(self, path, spark)

    @classmethod
    def load(cls, path: str, contamination: float = DEFAULT_CONTAMINATION, spark=None) -> "AnomalyDetector":
        """A saved detector; it keeps the threshold it was fitted with."""
        return model_store.load_detector(cls, path, contamination, spark)

    def _check_fitted(self) -> None:
        if self.forest is None:
            raise RuntimeError("call fit() before score()")


def run_detection(
    table: DataFrame, contamination: float = DEFAULT_CONTAMINATION, features: list[str] | None = None, **options
) -> DataFrame:
    """Fit and score in one call."""
    return AnomalyDetector(contamination, **options).fit_score(table, features)
