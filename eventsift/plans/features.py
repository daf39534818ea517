"""Feature matrix of an event table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsift.functions import fields
from eventsift.operators.behaviour import source_windows
from eventsift.operators.quantiles import exact_quantiles
from eventsift.operators.scaling import Scaler, fit_scaler
from eventsift.operators.text import Components, Vocabulary, fit_components, fit_vocabulary, projected
from eventsift.schema import MAX_TERMS, NUMERIC_FEATURES, TEXT_COMPONENTS, text_columns
from eventsift.storage import materialise, spread

_GAP = "seconds_since_prev_same_source"
_VOLUME = "events_per_min_same_source"


def temporal_features(events: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return events.withColumns(
        {"hour": fields.hour_of_day(ts), "day_of_week": fields.day_of_week(ts), "is_weekend": fields.is_weekend(ts)}
    )


def severity_feature(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", fields.severity(F.col("level")))


def numeric_features(events: DataFrame, max_group_rows: int = 2_000_000) -> DataFrame:
    """The seven numeric features; the gap is still null where it has to be filled."""
    windowed = source_windows(events, max_group_rows=max_group_rows, gap=_GAP, count=_VOLUME)
    with_length = windowed.withColumn("message_length", fields.message_length(F.col("message")))
    return severity_feature(temporal_features(with_length))


@dataclass
class FeatureModel:
    """Everything fitted for the matrix; small and independent of the number of events."""

    n_rows: int
    gap_fill: float
    vocabulary: Vocabulary
    components: Components
    scaler: Scaler

    @property
    def columns(self) -> list[str]:
        return self.scaler.columns

    def scaled(self, unscaled: DataFrame) -> DataFrame:
        """Unscaled features (see ``unscaled_features``) to the standardised matrix."""
        return self.scaler.transform(unscaled.fillna({_GAP: self.gap_fill}))

    def transform(self, events: DataFrame, max_group_rows: int = 2_000_000) -> DataFrame:
        """Standardised features of new events with the fitted values."""
        return self.scaled(unscaled_features(events, self.vocabulary, self.components, max_group_rows))


def unscaled_features(
    events: DataFrame, vocabulary: Vocabulary, components: Components, max_group_rows: int = 2_000_000
) -> DataFrame:
    text = projected(F.col("message"), vocabulary, components)
    names = text_columns(components.k)
    return (
        numeric_features(events, max_group_rows)
        .withColumn("_text", text)
        .withColumns({c: F.get("_text", i) for i, c in enumerate(names)})
        .drop("_text")
    )


def fit_features(
    events: DataFrame,
    max_terms: int = MAX_TERMS,
    text_components: int = TEXT_COMPONENTS,
    stop_words: list[str] | None = None,
    max_group_rows: int = 2_000_000,
) -> tuple[DataFrame, FeatureModel]:
    """Unscaled feature table, stored once, and the fitted model.

    ``events`` is read several times (columns pruned); pass a stored table, not a raw-file plan.
    """
    events = spread(events)
    n_rows = events.count()
    vocabulary = fit_vocabulary(events, n_rows, max_terms, stop_words)
    components = fit_components(events, vocabulary, text_components)
    unscaled = materialise(unscaled_features(events, vocabulary, components, max_group_rows), "features")
    gap_fill = exact_quantiles(unscaled, _GAP, [0.5])[0] or 0.0
    columns = [*NUMERIC_FEATURES, *text_columns(components.k)]
    scaler = fit_scaler(unscaled.fillna({_GAP: gap_fill}), columns)
    return unscaled, FeatureModel(n_rows, gap_fill, vocabulary, components, scaler)


def build_feature_matrix(events: DataFrame, **options) -> tuple[DataFrame, FeatureModel]:
    """Event columns plus the standardised feature columns, and the fitted model."""
    unscaled, model = fit_features(events, **options)
    return model.scaled(unscaled), model
