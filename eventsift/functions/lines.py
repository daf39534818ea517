"""Line formats: one regular expression pass per line, JVM side."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventsift.functions import times
from eventsift.schema import LEVEL_SEVERITY

# A line never contains a newline, so it is a safe separator between captured groups.
_SEP = "\n"

# Unicode blanks as text lines use them; `d` makes the newline the only line end.
_FLAGS = "(?Ud)"
_BLANK = r"[\s\x1c-\x1f]"
_SOLID = r"[^\s\x1c-\x1f]"

# The three line layouts.
GENERIC = (
    rf"{_FLAGS}^(\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}){_BLANK}+"
    rf"([A-Za-z]+){_BLANK}+([\p{{L}}\p{{N}}_\-.]+)?:?{_BLANK}*(.*)$"
)
SYSLOG = (
    rf"{_FLAGS}^([A-Za-z]{{3}}{_BLANK}+\d{{1,2}}{_BLANK}+\d{{2}}:\d{{2}}:\d{{2}}){_BLANK}+"
    rf"({_SOLID}+){_BLANK}+({_SOLID}+?):{_BLANK}*(.*)$"
)
APACHE_COMBINED = (
    rf"{_FLAGS}^({_SOLID}+){_BLANK}+{_SOLID}+{_BLANK}+{_SOLID}+{_BLANK}+\[([^\]]+)\]{_BLANK}+"
    rf'"([^"]*)"{_BLANK}+(\d{{3}}){_BLANK}+({_SOLID}+).*$'
)


@dataclass(frozen=True)
class LineFormat:
    """A named layout: ``build`` turns the captured groups (two or more) into the four event fields."""

    name: str
    pattern: str
    groups: int
    build: Callable[[list[Column]], dict[str, Column]]

    def matches(self, value: Column) -> Column:
        return value.rlike(self.pattern)

    def captured(self, value: Column) -> Column:
        """Array of the captured groups; the whole line as only element when it has another layout."""
        joined = _SEP.join(f"${i + 1}" for i in range(self.groups))
        return F.split(F.regexp_replace(value, F.lit(self.pattern), F.lit(joined)), _SEP)

    def fields_of(self, groups: str) -> Column:
        built = self.build([F.get(groups, i) for i in range(self.groups)])
        return F.struct(*[built[c].alias(c) for c in ("timestamp", "level", "source", "message")])


def known_level(level: Column) -> Column:
    """Upper-case level, INFO when it is not a known one."""
    return F.when(F.upper(level).isin(*LEVEL_SEVERITY), F.upper(level)).otherwise("INFO")


def or_unknown(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))


def status_level(status: Column) -> Column:
    code = status.try_cast("int")
    return F.when(code >= 500, "ERROR").when(code >= 400, "WARN").otherwise("INFO")


def _generic(g: list[Column]) -> dict[str, Column]:
    return {
        "timestamp": times.iso_time(g[0]),
        "level": known_level(g[1]),
        "source": or_unknown(g[2]),
        "message": g[3],
    }


def _apache(g: list[Column]) -> dict[str, Column]:
    return {
        "timestamp": times.web_server_time(g[1]),
        "level": status_level(g[3]),
        "source": or_unknown(g[0]),
        "message": F.concat(g[2], F.lit(" status="), g[3], F.lit(" size="), g[4]),
    }


def line_formats(syslog_year: int | None = None) -> list[LineFormat]:
    """The registry, in voting order; callers may append their own formats."""

    def _syslog(g: list[Column]) -> dict[str, Column]:
        return {
            "timestamp": times.syslog_time(g[0], syslog_year),
            "level": F.lit("INFO"),
            "source": or_unknown(g[1]),
            "message": F.btrim(F.concat(g[2], F.lit(": "), g[3]), F.lit(": ")),
        }

    return [
        LineFormat("generic", GENERIC, 4, _generic),
        LineFormat("syslog", SYSLOG, 4, _syslog),
        LineFormat("apache_combined", APACHE_COMBINED, 5, _apache),
    ]


def not_blank(value: Column) -> Column:
    return value.rlike(f"(?U){_SOLID}")


# Characters that end a line besides the ones Spark's text reader splits on.
EXTRA_LINE_ENDS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
