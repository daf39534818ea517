"""eventsift: unusual-event detection for log data on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from eventsift.operators.parse import (  # noqa: E402
    ParseResult,
    parse_csv_log,
    parse_log_file,
    parse_text_log,
)
from eventsift.operators.report import (  # noqa: E402
    level_counts,
    plot_series,
    preview,
    rank_results,
    redact_message,
    run_summary,
    top_anomalies,
    top_events,
    write_results,
)
from eventsift.operators.lof import local_outlier_factor  # noqa: E402
from eventsift.plans.detector import AnomalyDetector, run_detection  # noqa: E402
from eventsift.plans.features import FeatureModel, build_feature_matrix  # noqa: E402
from eventsift.plans.analysis import analyze, analyze_events  # noqa: E402
from eventsift.sources.guard import enforce_row_limit, validate_input  # noqa: E402

__all__ = [
    "AnomalyDetector",
    "FeatureModel",
    "ParseResult",
    "analyze",
    "analyze_events",
    "build_feature_matrix",
    "enforce_row_limit",
    "level_counts",
    "local_outlier_factor",
    "parse_csv_log",
    "parse_log_file",
    "parse_text_log",
    "plot_series",
    "preview",
    "rank_results",
    "redact_message",
    "run_detection",
    "run_summary",
    "top_anomalies",
    "top_events",
    "validate_input",
    "write_results",
]
