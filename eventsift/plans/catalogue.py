"""Named queries over the test tables, one or more per operator.

Every query reads whole tables. Log lines and log files are rendered from ``events`` first, so
the expected fields are known from its columns.
"""

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsift.functions import fields
from eventsift.functions.lines import line_formats, not_blank
from eventsift.operators import curves, report, text
from eventsift.operators.behaviour import source_windows
from eventsift.operators.curves import precision_recall_curve, threshold_counts
from eventsift.operators.forest import NODE_SCHEMA, Forest, fit_forest, sample_trees
from eventsift.operators.lof import local_outlier_factor
from eventsift.operators.ordered import event_positions
from eventsift.operators.parse import (
    canonicalise,
    format_votes,
    parse_csv_log,
    parse_lines,
    parse_log_file,
    parse_stats,
    parse_text_log,
)
from eventsift.operators.quantiles import exact_quantiles
from eventsift.operators.scaling import fit_scaler
from eventsift.operators.scores import contamination_sweep, fit_scale
from eventsift.plans.analysis import analyze_events, load_models, score_events
from eventsift.plans.detector import AnomalyDetector
from eventsift.plans.features import numeric_features, severity_feature, temporal_features
from eventsift.schema import EVENT_FIELDS, NUMERIC_FEATURES
from eventsift.sources.csv import ONE_TASK_BYTES
from eventsift.sources.guard import enforce_row_limit, list_input
from eventsift.sources.text import split_lines
from eventsift.storage import materialise, shared_dir, spread
from eventsift.streaming.late import LateWindows, read_windows
from eventsift.streaming.retraining import load_latest, retrain
from eventsift.streaming.scoring import (
    CarriedEvents,
    StreamScorer,
    StreamWindows,
    read_counts,
    read_scores,
    sliding_counts,
    store_counts,
)

STOP_WORDS = ["the", "and", "of", "to", "der", "die", "und", "le", "la", "les", "de", "user"]
SHARES = [0.02, 0.05, 0.1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The ``events`` table as parsed log events, with further columns of it if named."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "CRITICAL").when(kind == "signup", "WARN")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        level.otherwise("INFO").alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.concat(kind, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), F.col("props")).alias("message"),
        *extra,
    )


# ---- rendered lines ---------------------------------------------------------------------


def _second(ts: str = "ts") -> Column:
    return F.substring(F.col(ts).cast("string"), 1, 19)


def _source() -> Column:
    return F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))


def _generic_line() -> Column:
    kind = F.col("event_type")
    # Unknown and lower-case levels, and lines without a source, are part of the format.
    level = F.when(kind == "view", "NOTICE").when(kind == "click", "debug").when(kind == "error", "ERROR")
    head = F.concat(_second(), F.lit(" "), level.when(kind == "signup", "warning").otherwise("FATAL"), F.lit("  "))
    body = F.concat(_source(), F.lit(": "), kind, F.lit(" "), F.col("props"))
    return F.concat(head, F.when(F.col("user_id") % 5 == 0, F.col("props")).otherwise(body))


def _syslog_line() -> Column:
    day = F.lpad(F.day("ts").cast("string"), 2, " ")
    props = F.when(F.col("event_type") == "view", "").otherwise(F.col("props"))
    process = F.concat(F.col("event_type"), F.lit("["), F.col("user_id").cast("string"), F.lit("]: "))
    return F.concat(F.lit("Jan "), day, F.lit(" "), F.substring(_second(), 12, 8), F.lit(" "), _source(), F.lit(" "),
                    process, props)


def _apache_line() -> Column:
    kind, stamp = F.col("event_type"), _second()
    status = F.when(kind == "error", "503").when(kind == "signup", "404").when(kind == "view", "304").otherwise("200")
    day = F.concat(F.substring(stamp, 9, 2), F.lit("/Jan/2024:"), F.substring(stamp, 12, 8))
    zone = F.when(kind == "click", " +0230").otherwise(" +0000")
    return F.concat(
        _source(), F.lit(" - - ["), day, zone, F.lit('] "GET /'), kind, F.lit(' HTTP/1.1" '), status, F.lit(" "),
        F.col("user_id").cast("string"), F.lit(' "-" "agent/1.0"'),
    )


def _rendered(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"), _source().alias("file"))


def _parsed(spark: SparkSession, sf_dir: str, value: Column, fmt: str) -> DataFrame:
    lines = _rendered(spark, sf_dir, value)
    return parse_lines(lines, line_formats(syslog_year=2024), fmt=fmt).select("event_id", *EVENT_FIELDS, "parsed", "fmt")


def parse_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, _generic_line(), "generic")


def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, _syslog_line(), "syslog")


def parse_apache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, _apache_line(), "apache_combined")


def _mixed_line() -> Column:
    shape = F.col("user_id") % 5
    generic = F.when(F.col("event_type") == "error", _syslog_line()).otherwise(_generic_line())
    mixed = F.when(shape == 2, _syslog_line()).when(shape == 3, _apache_line()).when(shape == 4, F.col("props"))
    return mixed.otherwise(generic)


def parse_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _rendered(spark, sf_dir, _mixed_line())
    events = parse_lines(lines, line_formats(syslog_year=2024), detect="line")
    return events.select("event_id", *EVENT_FIELDS, "parsed", "fmt")


def parse_fallback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_stats(parse_lines(_rendered(spark, sf_dir, _mixed_line())), "file")


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_votes(_rendered(spark, sf_dir, _mixed_line()))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(split_lines(F.col("text"))).alias("line_no", "value"))
    lines = lines.filter(not_blank(F.col("value"))).withColumnsRenamed({"doc_id": "event_id", "source": "file"})
    events = parse_lines(lines, fmt="generic")
    return events.select(F.col("event_id").alias("doc_id"), "line_no", "level", "source", "message", "parsed")


# ---- files ------------------------------------------------------------------------------


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh_path(spark, "text")
    _rendered(spark, sf_dir, _generic_line()).select("value").write.text(path)
    return parse_text_log(spark, path).events.select(*EVENT_FIELDS, "parsed", "fmt")


def _csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("string").alias(" DateTime "),
        F.when(kind != "view", kind).alias("Severity"),
        F.when(kind == "click", "N/A").otherwise(_source()).alias("HOST"),
        F.lit("ignored").alias("level"),
        F.when(kind != "signup", F.concat(F.col("props"), F.lit('\n"'), kind, F.lit('", done'))).alias("msg"),
        F.col("user_id").alias("other"),
    )


def csv_files(spark: SparkSession, sf_dir: str, one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    path = _fresh_path(spark, "csv")
    _csv_records(spark, sf_dir).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return parse_csv_log(spark, path, one_task_bytes=one_task_bytes).events.select(*EVENT_FIELDS, "parsed", "fmt")


def csv_quoted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``csv_files`` by the way of files too large for one task, whose cells span lines."""
    return csv_files(spark, sf_dir, one_task_bytes=0)


def csv_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalise(_csv_records(spark, sf_dir)).select(*EVENT_FIELDS, "parsed", "fmt")


def log_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of folders with text (some of it compressed), CSV and other files at once."""
    path = _fresh_path(spark, "logs")
    events = log_events(spark, sf_dir)
    errors = events.filter("level = 'ERROR'").select(
        "event_id", F.concat(_second("timestamp"), F.lit(" ERROR "), "source", F.lit(": "), "message").alias("value")
    )
    errors.filter("event_id % 2 = 0").select("value").write.text(f"{path}/2026/06")
    errors.filter("event_id % 2 = 1").select("value").write.option("compression", "gzip").text(f"{path}/2026/07")
    events.write.json(f"{path}/other")
    report.write_events(events.filter("level <> 'ERROR'"), path, mode="append")
    return parse_log_file(spark, path).events.select(*EVENT_FIELDS, "fmt")


def csv_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a CSV export in nine layouts, three of them with an offset, and a text that is no time."""
    path, ts, k = _fresh_path(spark, "times"), F.col("ts").cast("timestamp"), F.col("event_id") % 10
    layouts = [
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'-05:00'",
        "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "MMM d, yyyy HH:mm:ss", "yyyyMMdd", "dd/MMM/yyyy:HH:mm:ss '+0000'",
    ]
    text = F.lit("some time")
    for i, layout in enumerate(layouts):
        text = F.when(k == i, F.date_format(ts, layout)).otherwise(text)
    records = table(spark, sf_dir, "events").select(text.alias("time"), F.col("event_id").alias("msg"))
    records.write.option("header", True).csv(path)
    found = parse_csv_log(spark, path).events
    return found.select(F.col("message").cast("bigint").alias("event_id"), "timestamp")


def csv_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export without level, source and time; an empty one beside it adds nothing."""
    path, events = _fresh_path(spark, "narrow"), table(spark, sf_dir, "events")
    records = events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.col("props")).alias("Log"))
    records.write.option("header", True).option("escape", '"').csv(f"{path}/some")
    records.filter("false").coalesce(1).write.option("header", True).csv(f"{path}/none")
    return parse_csv_log(spark, path).events.select(*EVENT_FIELDS, "parsed")


def bad_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of which every third has a byte that is not UTF-8."""
    path = _fresh_path(spark, "bytes")
    broken = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    line = F.concat(_second(), F.lit(" INFO svc: "), F.col("event_id").cast("string"), broken, F.lit("."))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return parse_text_log(spark, path).events.select("timestamp", "source", "message")


def input_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree by kind: why some are not read, and whether they have any bytes."""
    path, events = _fresh_path(spark, "guard"), log_events(spark, sf_dir)
    for level, writer in (("INFO", "text"), ("ERROR", "json"), ("WARN", "csv")):
        lines = events.filter(F.col("level") == level).select(F.col("message").alias("value"))
        lines.write.format(writer).save(f"{path}/{level}/{writer}")
    listed = list_input(spark, path).filter("length > 0")
    return listed.groupBy("kind", "reason").agg((F.count("*") > 0).alias("found"), (F.sum("length") > 0).alias("bytes"))


def null_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and trailing count where every seventh event has no time and every eleventh no source."""
    events = log_events(spark, sf_dir).withColumns(
        {
            "timestamp": F.when(F.col("event_id") % 7 != 0, F.col("timestamp")),
            "source": F.when(F.col("event_id") % 11 != 0, F.col("source")),
        }
    )
    return source_windows(events).select("event_id", "gap_seconds", "trailing_count")


def no_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap, trailing count and calendar features of events none of which has a time: no median to fill gaps with."""
    events = log_events(spark, sf_dir).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    gap, volume = "seconds_since_prev_same_source", "events_per_min_same_source"
    found = materialise(numeric_features(events).select("event_id", gap, volume, "hour", "day_of_week", "is_weekend"), "numeric")
    return found.fillna({gap: exact_quantiles(found, gap, [0.5])[0] or 0.0})


def row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first third of the events."""
    events = log_events(spark, sf_dir)
    return enforce_row_limit(events, events.count() // 3)


# ---- features ---------------------------------------------------------------------------


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = temporal_features(log_events(spark, sf_dir))
    return got.select("event_id", "hour", "day_of_week", "is_weekend")


def severity_of_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_feature(log_events(spark, sf_dir)).select("event_id", "severity")


def gap_same_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = source_windows(log_events(spark, sf_dir)).select("event_id", "gap_seconds")
    gaps = materialise(gaps, "gaps")
    fill = exact_quantiles(gaps, "gap_seconds", [0.5])[0] or 0.0
    return gaps.select("event_id", F.coalesce("gap_seconds", F.lit(fill)).alias("gap_seconds"))


def _counts(events: DataFrame, seconds: int, **options) -> DataFrame:
    return source_windows(events, seconds, **options).select("event_id", "trailing_count")


def rolling_count_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(log_events(spark, sf_dir), 60)


def rolling_count_3600s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(log_events(spark, sf_dir), 3600)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))


def rolling_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(_hourly(spark, sf_dir), 7200)


def rolling_hot_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result with nearly every slot above the size limit, by running totals."""
    return _counts(_hourly(spark, sf_dir), 7200, max_group_rows=4)


def message_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", fields.message_length(F.col("text")).alias("message_length")
    )


def truncate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", report.redact_message(F.col("text")).alias("message"))


def _numeric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = materialise(numeric_features(log_events(spark, sf_dir)).select("event_id", *NUMERIC_FEATURES), "numeric")
    fill = exact_quantiles(matrix, "seconds_since_prev_same_source", [0.5])[0] or 0.0
    filled = matrix.fillna({"seconds_since_prev_same_source": fill})
    return fit_scaler(filled, NUMERIC_FEATURES).transform(filled)


def standardise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _numeric_matrix(spark, sf_dir)
    return scaled.select("event_id", *[F.round(c, 6).alias(c) for c in NUMERIC_FEATURES])


# ---- text -------------------------------------------------------------------------------


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.message_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_frequencies(table(spark, sf_dir, "documents"), STOP_WORDS, "text")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_terms(term_frequencies(spark, sf_dir)).select("term", "term_idx", "corpus_freq", "doc_freq")


def _fitted_vocabulary(docs: DataFrame) -> text.Vocabulary:
    return text.fit_vocabulary(docs, docs.count(), stop_words=STOP_WORDS, message="text")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = text.tfidf_weights(docs, _fitted_vocabulary(docs), "doc_id", "text")
    return weights.select("doc_id", "term", "tf", F.round("weight", 7).alias("weight"))


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gram = text.gram_matrix(docs, _fitted_vocabulary(docs), "text")
    return gram.select("i", "j", F.round("value", 4).alias("value"))


def svd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vocab = _fitted_vocabulary(docs)
    parts = text.fit_components(docs, vocab, message="text")
    got = docs.select("doc_id", text.projected(F.col("text"), vocab, parts).alias("p"))
    return got.select("doc_id", *[F.get("p", i).alias(f"text_svd_{i}") for i in range(parts.k)])


def svd_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all terms of the documents, judged by what makes them the singular vectors.

    Per component: energy of its projections over its squared singular value (1), the largest product with another component's
    projections over both singular values (0), whether the Gram matrix only stretches it; and the squared sum of all weights.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vocab = text.fit_vocabulary(docs, docs.count(), 20_000, STOP_WORDS, "text")
    parts = text.fit_components(docs, vocab, message="text")
    rows = materialise(docs.select(text.projected(F.col("text"), vocab, parts).alias("p")), "projected")
    pairs = [(i, j) for i in range(parts.k) for j in range(parts.k)]
    sums = rows.agg(*[F.sum(F.get("p", i) * F.get("p", j)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    weights = text.sparse_weights(docs, vocab, "text")
    stretched = text.gram_product(weights, parts.loadings) - parts.loadings * parts.singular_values**2
    total = weights.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))).first()[0]
    sigma = parts.singular_values
    found = []
    for i in range(parts.k):
        cross = max(abs(sums[f"s{i}_{j}"]) / float(sigma[i] * sigma[j]) for j in range(parts.k) if j != i)
        fixed = bool(abs(stretched[:, i]).max() < 1e-7 * sigma[0] ** 2)
        found.append((i, round(sums[f"s{i}_{i}"] / float(sigma[i] ** 2), 7), abs(round(cross, 7)), fixed, round(total, 5)))
    schema = "component int, energy double, largest_cross double, only_stretched boolean, squared_weights double"
    return spark.createDataFrame(found, schema)


# ---- forest and scores ------------------------------------------------------------------


def forest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return sample_trees(events, events.count()).select("tree_id", "event_id", "sample_key")


# Three small trees over (value, hour): tree, node, feature, threshold, rows, depth.
FIXED_NODES = [
    (0, 0, 0, 50.0, 8, 0), (0, 1, 1, 11.5, 5, 1), (0, 2, -1, 0.0, 3, 1), (0, 3, -1, 0.0, 4, 2), (0, 4, -1, 0.0, 1, 2),
    (1, 0, 1, 5.5, 8, 0), (1, 1, -1, 0.0, 2, 1), (1, 2, 0, 20.25, 6, 1), (1, 5, -1, 0.0, 1, 2), (1, 6, 0, 120.0, 5, 2),
    (1, 13, -1, 0.0, 4, 3), (1, 14, -1, 0.0, 1, 3),
    (2, 0, -1, 0.0, 8, 0),
]


def forest_score_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    forest = Forest(["value", "hour"], 3, 8, FIXED_NODES)
    return events.select("event_id", F.round(forest.raw_score(), 9).alias("raw_score"))


def _z_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with the z-score of ``value`` as raw score."""
    events = log_events(spark, sf_dir, "value")
    return events.withColumn("raw", fit_scaler(events, ["value"]).scaled("value")).drop("value")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialise(_z_scored(spark, sf_dir), "scored")
    return fit_scale(scored, "raw", 0.05).attach(scored, "raw").drop("raw")


def score_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("event_id", "anomaly_score")


def contamination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("event_id", "is_anomaly")


def contamination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_sweep(materialise(_z_scored(spark, sf_dir).select("raw"), "raw"), "raw", SHARES)


def exact_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by repeated counting, as for tables too large for the built-in aggregate."""
    probs = [0.01, 0.05, 0.5, 0.95, 0.999]
    values = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    found = exact_quantiles(values, "l_extendedprice", probs, in_memory_rows=1000)
    return spark.createDataFrame(list(zip(probs, found)), "prob double, value double").select(
        "prob", F.round("value", 6).alias("value")
    )


def detect_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: features, forest, scores and flags of all events."""
    return analyze_events(log_events(spark, sf_dir)).results.select("event_id", *EVENT_FIELDS, "anomaly_score", "is_anomaly")


def _forest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven standardised numeric features, to six places so that every engine cuts the same values."""
    return materialise(standardise_features(spark, sf_dir), "rounded")


def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 trees fitted on all events."""
    table_ = _forest_table(spark, sf_dir)
    forest = fit_forest(table_, NUMERIC_FEATURES, table_.count())
    nodes = spark.createDataFrame(forest.nodes, NODE_SCHEMA)
    return nodes.withColumn("threshold", F.round("threshold", 9))


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events scored by the forest fitted on them."""
    table_ = _forest_table(spark, sf_dir)
    scored = AnomalyDetector().fit(table_, NUMERIC_FEATURES).raw_scores(table_)
    return scored.select("event_id", F.round("raw_score", 9).alias("raw_score"))


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and scale of a detection on the numeric features."""
    table_ = _forest_table(spark, sf_dir)
    results = AnomalyDetector().fit_score(table_, NUMERIC_FEATURES)
    return results.agg(
        F.count("*").alias("events"),
        F.count_if("is_anomaly").alias("flagged"),
        F.sum(F.when(F.col("is_anomaly"), F.col("event_id"))).alias("flagged_ids"),
        F.round(F.avg("anomaly_score"), 2).alias("mean_score"),
        F.min("anomaly_score").alias("lowest"),
        F.max("anomaly_score").alias("highest"),
    )


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored by a fitted and by a stored model: how many scores agree."""
    path = _fresh_path(spark, "model")
    run = analyze_events(log_events(spark, sf_dir))
    run.save(path)
    features, detector = load_models(spark, path)
    again = score_events(log_events(spark, sf_dir), features, detector)
    both = run.results.select("event_id", F.col("anomaly_score").alias("a")).join(
        again.select("event_id", F.col("anomaly_score").alias("b")), "event_id"
    )
    return both.agg(F.count("*").alias("events"), F.count_if(F.abs(F.col("a") - F.col("b")) < 0.011).alias("equal_scores"))


# ---- reports ----------------------------------------------------------------------------


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_summary(_flagged(spark, sf_dir), "csv", 1.0)


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.level_counts(log_events(spark, sf_dir))


def top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_anomalies(_flagged(spark, sf_dir))


def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_events(_flagged(spark, sf_dir)).select("event_id", "timestamp", "level", "anomaly_score")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.preview(log_events(spark, sf_dir))


def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.plot_series(_flagged(spark, sf_dir), ["event_id"])


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every event in time order."""
    return event_positions(log_events(spark, sf_dir), ["timestamp", "event_id"]).select("event_id", "event_index")


def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked results written as CSV and read again."""
    path = _fresh_path(spark, "results")
    report.write_results(_flagged(spark, sf_dir), path)
    schema = "timestamp timestamp_ntz, level string, source string, message string, anomaly_score double, is_anomaly boolean"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents as flags against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("raw"))
    flagged = fit_scale(docs, "raw", 0.1).attach(docs, "raw")
    return report.label_metrics(flagged, table(spark, sf_dir, "labels"), F.col("quality") == 0, "doc_id")


def _length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of document length as a score for poor quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return threshold_counts(docs, table(spark, sf_dir, "labels"), "n_chars", F.col("quality") == 0, "doc_id")


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = precision_recall_curve(_length_counts(spark, sf_dir))
    return curve.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.ranking_quality(_length_counts(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("average_precision", "roc_area")})


# ---- neighbours -------------------------------------------------------------------------


def lof_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = local_outlier_factor(table(spark, sf_dir, "embeddings"), "embedding", id_col="vec_id", cell_rows=200)
    return got.select("vec_id", F.round("k_distance", 7).alias("k_distance"), F.round("lof", 6).alias("lof"), "is_anomaly")


def lof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = local_outlier_factor(_forest_table(spark, sf_dir), NUMERIC_FEATURES)
    return got.select("event_id", F.round("lof", 5).alias("lof"), "is_anomaly")


def detector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events flagged by the forest, by LOF and by both."""
    matrix = _forest_table(spark, sf_dir)
    forest = AnomalyDetector().fit_score(matrix, NUMERIC_FEATURES, ["event_id"])
    return report.detector_agreement(forest, local_outlier_factor(matrix, NUMERIC_FEATURES))


def flag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score columns of the same rows flagged separately and compared."""
    lines = table(spark, sf_dir, "lineitem")
    sums = materialise(
        lines.groupBy(F.col("l_orderkey").alias("event_id")).agg(
            F.sum("l_quantity").cast("double").alias("a"), F.max("l_extendedprice").cast("double").alias("b")
        ),
        "sums",
    )
    left, right = fit_scale(sums, "a", 0.05), fit_scale(sums, "b", 0.05)
    return report.detector_agreement(left.attach(sums, "a"), right.attach(sums, "b"))


# ---- streams ----------------------------------------------------------------------------


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 s windows of a stream over ``events``, every 10 s, the last open ones included."""
    out = _fresh_path(spark, "stream")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(F.col("ts").alias("timestamp"), _source().alias("source"))
    counts = sliding_counts(events, delay="10 minutes")
    store_counts(counts, f"{out}/data", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return read_counts(spark, f"{out}/data")


def _oldest_first(spark: SparkSession, sf_dir: str, events: DataFrame, order: Column | None = None) -> str:
    """A folder with ``events`` in four files, one for each quarter of their time (or of ``order``), written oldest first."""
    order = F.col("timestamp") if order is None else order
    path = _fresh_path(spark, "stream")
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    quarter = (last - first) / 4
    for i in range(4):
        # File times decide the order, so the files are written one after the other.
        start, end = first + i * quarter, first + (i + 1) * quarter
        slice_ = order >= F.lit(start).cast("timestamp_ntz")
        if i < 3:
            slice_ &= order < F.lit(end).cast("timestamp_ntz")
        events.filter(slice_).write.mode("append").parquet(f"{path}/in")
    return path


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and trailing count of a stream that gets ``events`` in four files, oldest first."""
    events = log_events(spark, sf_dir).select("event_id", "timestamp", "source")
    path = _oldest_first(spark, sf_dir, events)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    windows = StreamWindows(f"{path}/out", CarriedEvents(f"{path}/carried"))
    windows.start_on(stream, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "gap_seconds", "trailing_count")


def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap and trailing count of a stream that gets ``events`` up to six hours late, so out of order."""
    events = log_events(spark, sf_dir).select("event_id", "timestamp", "source")
    delay = 6 * 3600
    late_by = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(delay)).cast("decimal(18,6)"))
    path = _oldest_first(spark, sf_dir, events, F.col("timestamp") + late_by)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    windows = LateWindows(f"{path}/out", f"{path}/open", delay_seconds=delay)
    windows.start_on(stream, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return read_windows(spark, f"{path}/out").select("event_id", "gap_seconds", "trailing_count")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored as a stream and as one batch by the same model: how many scores and flags agree, by level."""
    events = log_events(spark, sf_dir)
    run = analyze_events(events)
    model = _fresh_path(spark, "model")
    run.save(model)
    features, detector = load_models(spark, model)
    path = _oldest_first(spark, sf_dir, events)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    scorer = StreamScorer(features, detector, f"{path}/out", CarriedEvents(f"{path}/carried"))
    scorer.start_on(stream, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    streamed = read_scores(spark, f"{path}/out").select("event_id", "level", F.col("anomaly_score").alias("a"), F.col("is_anomaly").alias("f"))
    batch = score_events(events, features, detector).select("event_id", "anomaly_score", "is_anomaly")
    both = streamed.join(batch, "event_id")
    return both.groupBy("level").agg(
        F.count("*").alias("events"),
        F.count_if(F.abs(F.col("a") - F.col("anomaly_score")) < 0.011).alias("equal_scores"),
        F.count_if(F.col("f") == F.col("is_anomaly")).alias("equal_flags"),
    )


def retrained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events scored, without refitting, by a model of the last ten days."""
    path = _fresh_path(spark, "versions")
    events = log_events(spark, sf_dir)
    newest = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    retrain(events, newest, datetime.timedelta(days=10), path)
    features, detector = load_latest(spark, path)
    return score_events(events, features, detector).select("event_id", "anomaly_score", "is_anomaly")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_generic, parse_syslog, parse_apache, parse_by_line, parse_fallback_stats, detect_format, document_lines,
        text_files, csv_files, csv_quoted_blocks, csv_canonicalise, csv_times, csv_missing_columns, bad_bytes, input_guard,
        log_folder, row_limit, null_time_windows, no_times,
        calendar_features, severity_of_level, gap_same_source, rolling_count_60s, rolling_count_3600s, rolling_ties,
        rolling_hot_source, message_lengths, truncate_messages, standardise_features,
        tokens, term_frequencies, vocabulary, tfidf_weights, gram_matrix, svd_features, svd_identities,
        forest_sample, forest_score_fixed, score_rescale, contamination_flags, contamination_counts, exact_thresholds,
        forest_nodes, forest_scores, detect_anomalies, detection_counts, model_roundtrip,
        run_summary, level_counts, top_anomalies, top_events, preview, plot_series, time_order, results_csv,
        label_metrics, precision_recall, ranking_quality, lof_embeddings, lof_events, detector_agreement, flag_agreement, stream_sliding_counts,
        stream_windows, stream_late_windows, stream_scores, retrained_scores,
    )
}
