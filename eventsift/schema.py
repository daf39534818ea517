"""Column names and fixed values shared by every module."""

from pyspark.sql import types as T

# The event table: one row per log line or CSV record.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("parsed", T.BooleanType()),
        T.StructField("fmt", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("block_start", T.LongType()),
    ]
)

EVENT_FIELDS = ["timestamp", "level", "source", "message"]

# The levels a text line may carry, and their severity.
LEVEL_SEVERITY = {
    "DEBUG": 0,
    "INFO": 1,
    "WARN": 2,
    "WARNING": 2,
    "ERROR": 3,
    "CRITICAL": 4,
    "FATAL": 4,
}
DEFAULT_SEVERITY = 1

# Feature columns that precede the text components, in matrix order.
NUMERIC_FEATURES = [
    "hour",
    "day_of_week",
    "is_weekend",
    "seconds_since_prev_same_source",
    "severity",
    "events_per_min_same_source",
    "message_length",
]
TEXT_PREFIX = "text_svd_"


def text_columns(k: int) -> list[str]:
    return [f"{TEXT_PREFIX}{i}" for i in range(k)]


# Default model parameters.
DEFAULT_CONTAMINATION = 0.05
DEFAULT_TREES = 200
MAX_SAMPLES = 256
RANDOM_SEED = 42
ROLLING_WINDOW_SECONDS = 60
MAX_TERMS = 500
TEXT_COMPONENTS = 8
