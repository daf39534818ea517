"""Per-row feature expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventsift.schema import DEFAULT_SEVERITY, LEVEL_SEVERITY


def hour_of_day(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(-1)).cast("double")


def day_of_week(ts: Column) -> Column:
    """Monday is 0; -1 without a time."""
    return F.coalesce(F.weekday(ts), F.lit(-1)).cast("double")


def is_weekend(ts: Column) -> Column:
    return F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)).cast("double")


def severity(level: Column) -> Column:
    steps = F.when(F.lit(False), 0)
    for name, value in LEVEL_SEVERITY.items():
        steps = steps.when(level == name, value)
    return steps.otherwise(DEFAULT_SEVERITY).cast("double")


def message_length(message: Column) -> Column:
    return F.length(F.coalesce(message, F.lit(""))).cast("double")


def truncated(message: Column, max_len: int = 200) -> Column:
    text = F.coalesce(message, F.lit(""))
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, max_len), F.lit("…"))).otherwise(text)


# Tokens: two or more word characters, whole text, case folded.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(message: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(message, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
