"""Timestamps without session time zone effects."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of syslog and web server logs.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# One-byte blanks between the parts of a syslog time.
_BLANKS = " \t\x0b\x0c\x1c\x1d\x1e\x1f"

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    since = ts - F.expr(_EPOCH)
    seconds = since.cast("interval second").cast("decimal(20,6)")
    return (seconds * 1000000).cast("bigint")


def from_micros(us: Column) -> Column:
    return F.expr(_EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    )


def iso_time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


# The end of an ISO time with a zone.
_ZONED = r"\d:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)\s*$"


def zoned_time(text: Column) -> Column:
    """ISO text; a time with an offset becomes UTC wall time, one without stays as it is."""
    instant = from_micros(F.unix_micros(text.try_cast("timestamp")))
    return F.when(text.rlike(_ZONED), instant).otherwise(iso_time(text))


def _month(name: Column) -> Column:
    # 0 for an unknown name, which makes the assembled date invalid and so null.
    at = F.instr(F.lit(MONTHS), F.lower(name))
    return F.lpad(F.when(at % 3 == 1, (at + 2) / 3).otherwise(0).cast("int").cast("string"), 2, "0")


def web_server_time(text: Column) -> Column:
    """``01/Jun/2026:08:14:02 +0200`` as UTC wall time."""
    stamp = F.concat(
        F.substring(text, 8, 4), F.lit("-"), _month(F.substring(text, 4, 3)), F.lit("-"),
        F.substring(text, 1, 2), F.lit(" "), F.substring(text, 13, 8),
    )
    minutes = F.substring(text, 23, 2).try_cast("int") * 60 + F.substring(text, 25, 2).try_cast("int")
    signed = F.when(F.substring(text, 22, 1) == "-", -minutes).otherwise(minutes)
    none = F.expr("INTERVAL '0' MINUTE")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(signed, F.lit(0)))
    return iso_time(stamp) - F.when(F.substring(text, 21, 6) == " +0000", none).otherwise(shift)


def syslog_time(text: Column, year: int | None) -> Column:
    """``Jun  1 08:14:02``; the format has no year, so without one the time stays null."""
    if year is None:
        return F.lit(None).cast("timestamp_ntz")
    day = F.btrim(F.substring(text, F.lit(4), F.length(text) - 11), F.lit(_BLANKS))
    stamp = F.concat(
        F.lit(f"{year:04d}-"), _month(F.substring(text, 1, 3)), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "),
        F.substring(text, -8, 8),
    )
    return iso_time(stamp)


# Further layouts accepted in CSV exports, month first.
CSV_TIME_FORMATS = [
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy hh:mm a",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
    "d MMM yyyy HH:mm:ss",
]

# Eight digits that are a date, not seconds.
_DAY = r"^\s*(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\s*$"
_WEB = r"^\s*\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\s*$"

_EPOCH_MICROS = {"s": "1000000", "ms": "1000", "us": "1", "ns": "0.001"}


def csv_time(text: Column, epoch_unit: str = "s", formats: list[str] | None = None) -> Column:
    """Time of a CSV cell: ISO text, a number counted from 1970, eight digits of a date, a web server time, or
    one of ``formats``. Times with an offset become UTC."""
    number = text.rlike(r"^\s*-?\d+(\.\d+)?\s*$")
    us = (F.trim(text).try_cast("decimal(30,6)") * F.lit(_EPOCH_MICROS[epoch_unit]).cast("decimal(10,3)")).try_cast(
        "bigint"
    )
    tries = [zoned_time(text)]
    for fmt in CSV_TIME_FORMATS if formats is None else formats:
        # The session zone cancels out: text -> instant -> wall time in the same zone.
        tries.append(F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
    day = F.regexp_replace(F.trim(text), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return (
        F.when(text.rlike(_DAY), iso_time(day))
        .when(number, from_micros(us))
        .when(text.rlike(_WEB), web_server_time(F.trim(text)))
        .otherwise(F.coalesce(*tries))
    )
