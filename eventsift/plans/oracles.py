"""DuckDB SQL with the expected result of each catalogue query.

Expected fields are taken from the columns the lines were rendered from, not parsed.
"""

from eventsift.plans.catalogue import SHARES, STOP_WORDS

_LOGS = """logs AS (
  SELECT event_id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL'
                    WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
    concat('svc-', CAST(user_id % 5 AS VARCHAR)) AS source,
    concat(event_type, ' user ', CAST(user_id AS VARCHAR), ' ', props) AS message,
    value
  FROM events)"""

_SRC = "concat('svc-', CAST(user_id % 5 AS VARCHAR))"
_SECOND = "date_trunc('second', ts)"

# Fields of a line rendered in each layout.
_GENERIC = {
    "timestamp": f"CAST({_SECOND} AS TIMESTAMP)",
    "level": "CASE event_type WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' "
    "WHEN 'signup' THEN 'WARNING' ELSE 'FATAL' END",
    "source": f"CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE {_SRC} END",
    "message": "CASE WHEN user_id % 5 = 0 THEN props ELSE concat(event_type, ' ', props) END",
}
_SYSLOG = {
    "timestamp": f"CAST({_SECOND} AS TIMESTAMP)",
    "level": "'INFO'",
    "source": _SRC,
    "message": "concat(event_type, '[', CAST(user_id AS VARCHAR), ']', "
    "CASE WHEN event_type = 'view' THEN '' ELSE concat(': ', props) END)",
}
_STATUS = "CASE event_type WHEN 'error' THEN '503' WHEN 'signup' THEN '404' WHEN 'view' THEN '304' ELSE '200' END"
_APACHE = {
    "timestamp": f"CAST({_SECOND} - CASE WHEN event_type = 'click' THEN INTERVAL 150 MINUTE "
    "ELSE INTERVAL 0 MINUTE END AS TIMESTAMP)",
    "level": "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END",
    "source": _SRC,
    "message": f"concat('GET /', event_type, ' HTTP/1.1 status=', {_STATUS}, ' size=', CAST(user_id AS VARCHAR))",
}
_RAW = {"timestamp": "CAST(NULL AS TIMESTAMP)", "level": "NULL", "source": "NULL", "message": "props"}


def _select(fields: dict[str, str], fmt: str) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return f"SELECT event_id, {cols}, true AS parsed, '{fmt}' AS fmt FROM events"


# Layout of the line that _mixed_line renders for a row.
_SHAPE = """CASE user_id % 5 WHEN 2 THEN 'syslog' WHEN 3 THEN 'apache_combined' WHEN 4 THEN 'none'
  ELSE CASE WHEN event_type = 'error' THEN 'syslog' ELSE 'generic' END END"""


def _by_shape(field: str) -> str:
    return (
        f"CASE shape WHEN 'generic' THEN {_GENERIC[field]} WHEN 'syslog' THEN {_SYSLOG[field]} "
        f"WHEN 'apache_combined' THEN {_APACHE[field]} ELSE {_RAW[field]} END AS {field}"
    )


_VOTES = f"""head AS (
  SELECT {_SRC} AS file, {_SHAPE} AS shape,
    row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events),
votes AS (
  SELECT file, count(*) FILTER (shape = 'generic') AS votes_generic, count(*) FILTER (shape = 'syslog') AS votes_syslog,
    count(*) FILTER (shape = 'apache_combined') AS votes_apache_combined
  FROM head WHERE n <= 25 GROUP BY file),
won AS (
  SELECT *, CASE WHEN votes_generic >= greatest(votes_syslog, votes_apache_combined) THEN 'generic'
                 WHEN votes_syslog >= votes_apache_combined THEN 'syslog' ELSE 'apache_combined' END AS fmt
  FROM votes)"""

_CSV_FIELDS = """ts AS timestamp, coalesce(upper(nullif(event_type, 'view')), 'INFO') AS level,
  CASE WHEN event_type = 'click' THEN 'unknown' ELSE concat('svc-', CAST(user_id % 5 AS VARCHAR)) END AS source,
  CASE WHEN event_type = 'signup' THEN '' ELSE concat(props, chr(10), '"', event_type, '", done') END AS message,
  true AS parsed, 'csv' AS fmt FROM events"""


def _rows_until(window: str, source: str = "logs", order: str = "timestamp") -> str:
    """Trailing count in row order: equal times count one by one, by event_id."""
    return f"""SELECT event_id, CAST(count(*) OVER (PARTITION BY source ORDER BY {order}
        RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)
      - (count(*) OVER (PARTITION BY source, {order})
         - row_number() OVER (PARTITION BY source, {order} ORDER BY event_id)) AS DOUBLE) AS trailing_count
    FROM {source}"""


_HOURLY = f"WITH {_LOGS}, hourly AS (SELECT event_id, source, date_trunc('hour', timestamp) AS timestamp FROM logs) "
_TIES = _HOURLY + _rows_until("INTERVAL 7199999999 MICROSECONDS", "hourly")

_GAPS = """gaps AS (
  SELECT event_id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY source ORDER BY timestamp, event_id))
    / 1000000.0 AS gap FROM logs)"""

_SCALED = [
    "hour", "day_of_week", "is_weekend", "seconds_since_prev_same_source", "severity", "events_per_min_same_source",
    "message_length",
]

_FEATURES = f"""WITH {_LOGS}, {_GAPS}, counts AS ({_rows_until("INTERVAL 59999999 MICROSECONDS")}),
features AS (
  SELECT event_id, CAST(hour(timestamp) AS DOUBLE) AS hour, CAST(isodow(timestamp) - 1 AS DOUBLE) AS day_of_week,
    CASE WHEN isodow(timestamp) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend,
    coalesce(gap, (SELECT median(gap) FROM gaps)) AS seconds_since_prev_same_source,
    CAST(CASE level WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'WARN' THEN 2 ELSE 1 END AS DOUBLE) AS severity,
    trailing_count AS events_per_min_same_source, CAST(length(message) AS DOUBLE) AS message_length
  FROM logs JOIN gaps USING (event_id) JOIN counts USING (event_id))"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = f"""uses AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
frequencies AS (
  SELECT term, count(*) AS corpus_freq, count(DISTINCT doc_id) AS doc_freq FROM uses
  WHERE term NOT IN ({_STOP}) GROUP BY term),
kept AS (SELECT * FROM frequencies ORDER BY corpus_freq DESC, term LIMIT 500),
vocabulary AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, corpus_freq, doc_freq FROM kept)"""
_WEIGHTS = f"""{_TERMS},
raw AS (
  SELECT doc_id, term, term_idx, count(*) AS tf,
    count(*) * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + doc_freq)) + 1) AS w
  FROM uses JOIN vocabulary USING (term) GROUP BY doc_id, term, term_idx, doc_freq),
weights AS (SELECT doc_id, term, term_idx, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""

_SAMPLE = """WITH shape AS (
  SELECT least(256, count(*)) AS size, least(200, greatest(1, count(*) // least(256, count(*)))) AS per_round FROM events),
rounds AS (SELECT unnest(range(CAST(ceil(200.0 / per_round) AS BIGINT))) AS round_no, size, per_round FROM shape),
keyed AS (
  SELECT round_no, size, per_round, event_id,
    CAST(concat('0x', substr(md5(concat(event_id, '-', round_no, '-42')), 1, 15)) AS BIGINT) AS sample_key
  FROM events, rounds),
ranked AS (SELECT *, row_number() OVER (PARTITION BY round_no ORDER BY sample_key, event_id) - 1 AS n FROM keyed)
SELECT CAST(round_no * per_round + n // size AS INTEGER) AS tree_id, event_id, sample_key FROM ranked
WHERE n < per_round * size AND round_no * per_round + n // size < 200"""

# Trees over the rounded features: every node draws its feature and cut from md5(seed, tree, node).
_ROUNDED = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6)" for c in _SCALED)
_LOW = ", ".join(f"min(x[{i}]) OVER node" for i in range(1, 8))
_HIGH = ", ".join(f"max(x[{i}]) OVER node" for i in range(1, 8))


def _draw(start: int) -> str:
    digits = f"substr(md5(concat('42-', tree_id, '-', node_id)), {start}, 12)"
    return f"(CAST(concat('0x', {digits}) AS BIGINT) / 281474976710656.0::DOUBLE)"


_SPLIT = f"""SELECT *, CASE WHEN cut0 >= high[f] THEN low[f] ELSE cut0 END AS cut FROM (
  SELECT *, low[f] + {_draw(13)} * (high[f] - low[f]) AS cut0 FROM (
    SELECT *, CASE WHEN depth < (SELECT max_depth FROM bounds) AND n > 1 THEN open[1 + CAST(floor({_draw(1)} * len(open)) AS BIGINT)] END AS f
    FROM (
      SELECT *, list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: high[i] > low[i] + 1e-7) AS open FROM (
        SELECT *, [{_LOW}] AS low, [{_HIGH}] AS high, count(*) OVER node AS n FROM grown
        WINDOW node AS (PARTITION BY tree_id, node_id)))))"""
_TREES = f"""{_FEATURES.replace("WITH ", "WITH RECURSIVE ", 1)},
matrix AS (SELECT event_id, [{_ROUNDED}] AS x FROM features),
sample AS ({_SAMPLE}),
bounds AS (SELECT least(256, count(*)) AS size, CAST(ceil(log2(greatest(least(256, count(*)), 2))) AS INTEGER) AS max_depth FROM events),
grown AS (
  SELECT tree_id, CAST(0 AS BIGINT) AS node_id, 0 AS depth, x FROM sample JOIN matrix USING (event_id)
  UNION ALL
  SELECT tree_id, 2 * node_id + CASE WHEN x[f] <= cut THEN 1 ELSE 2 END, depth + 1, x FROM ({_SPLIT}) WHERE f IS NOT NULL),
nodes AS (
  SELECT tree_id, CAST(node_id AS INTEGER) AS node_id, CAST(coalesce(any_value(f), 0) - 1 AS INTEGER) AS feature,
    coalesce(any_value(CASE WHEN f IS NOT NULL THEN cut END), 0.0::DOUBLE) AS threshold,
    CAST(count(*) AS INTEGER) AS n_samples, any_value(depth) AS depth
  FROM ({_SPLIT}) GROUP BY tree_id, node_id)"""
_LENGTH = "CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} END"
_SCORES = f"""{_TREES},
walked AS (
  SELECT event_id, x, tree_id, feature, threshold, n_samples, node_id, depth FROM matrix, nodes WHERE node_id = 0
  UNION ALL
  SELECT w.event_id, w.x, w.tree_id, k.feature, k.threshold, k.n_samples, k.node_id, k.depth FROM walked w JOIN nodes k
  ON k.tree_id = w.tree_id AND k.node_id = 2 * w.node_id + CASE WHEN w.x[w.feature + 1] <= w.threshold THEN 1 ELSE 2 END
  WHERE w.feature >= 0),
scores AS (
  SELECT event_id, round(pow(2, -sum(depth + {_LENGTH.format(n="n_samples")})
    / (200 * (SELECT {_LENGTH.format(n="size")} FROM bounds))), 9) AS raw FROM walked WHERE feature < 0 GROUP BY event_id)"""

# c(n), the mean depth among n points, for the leaf sizes of the fixed trees.
_C3 = "(2 * (ln(2) + 0.5772156649015329) - 4.0 / 3)"
_C4 = "(2 * (ln(3) + 0.5772156649015329) - 6.0 / 4)"
_C8 = "(2 * (ln(7) + 0.5772156649015329) - 14.0 / 8)"
_FIXED = f"""SELECT event_id, round(pow(2, -(
    CASE WHEN value <= 50 THEN CASE WHEN hour(ts) <= 11.5 THEN 2 + {_C4} ELSE 2 END ELSE 1 + {_C3} END
  + CASE WHEN hour(ts) <= 5.5 THEN 1 + 1.0
         WHEN value <= 20.25 THEN 2 WHEN value <= 120 THEN 3 + {_C4} ELSE 3 END
  + {_C8}) / (3 * {_C8})), 9) AS raw_score FROM events"""

_Z = f"""{_LOGS}, z AS (
  SELECT *, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS raw FROM logs),
bounds AS (SELECT min(raw) AS lo, max(raw) AS hi, -quantile_cont(-raw, 0.05) AS cut FROM z),
flagged AS (
  SELECT event_id, timestamp, level, source, message, round_even((raw - lo) / (hi - lo) * 100, 2) AS anomaly_score,
    raw > cut AS is_anomaly FROM z, bounds)"""
_SHORT = "CASE WHEN length(message) > 200 THEN concat(substr(message, 1, 200), '…') ELSE message END"

_LOF = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id, b.vec_id AS nid, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
edges AS (
  SELECT vec_id, nid, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) AS n FROM pairs) WHERE n <= 20),
kd AS (SELECT vec_id, max(d) AS k_distance FROM edges GROUP BY vec_id),
lrd AS (
  SELECT e.vec_id, 1 / (avg(greatest(d, k_distance)) + 1e-10) AS density
  FROM edges e JOIN kd ON kd.vec_id = e.nid GROUP BY e.vec_id),
lof AS (
  SELECT e.vec_id, avg(n.density) / any_value(o.density) AS lof
  FROM edges e JOIN lrd n ON n.vec_id = e.nid JOIN lrd o ON o.vec_id = e.vec_id GROUP BY e.vec_id)
SELECT vec_id, round(k_distance, 7) AS k_distance, round(lof, 6) AS lof,
  lof > (SELECT -quantile_cont(-lof, 0.05) FROM lof) AS is_anomaly
FROM lof JOIN kd USING (vec_id)"""

_METRICS = """counts AS (
  SELECT count(*) FILTER (f AND y) AS true_positives, count(*) FILTER (f AND NOT y) AS false_positives,
    count(*) FILTER (NOT f AND y) AS false_negatives, count(*) FILTER (NOT f AND NOT y) AS true_negatives FROM joined)
SELECT *, true_positives / nullif(true_positives + false_positives, 0) AS precision,
  true_positives / nullif(true_positives + false_negatives, 0) AS recall,
  2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0) AS f1 FROM counts"""

_STREAM = """WITH src AS (
  SELECT concat('svc-', CAST(user_id % 5 AS VARCHAR)) AS source, ts FROM events),
starts AS (
  SELECT source, ts, time_bucket(INTERVAL 10 SECOND, ts, TIMESTAMP '1970-01-01') - INTERVAL 10 SECOND * k AS window_start
  FROM src, range(6) r(k))
SELECT source, window_start, window_start + INTERVAL 60 SECOND AS window_end, count(*) AS events FROM starts
GROUP BY source, window_start"""

# LOF of the rounded features of all events; ``matrix`` has them.
_EVENT_LOF = """near AS (
  SELECT a.event_id, unnest(min({'d': list_distance(a.x, b.x), 'nid': b.event_id}, 20)) AS n
  FROM matrix a JOIN matrix b ON a.event_id <> b.event_id GROUP BY a.event_id),
edges AS (SELECT event_id, n.nid AS nid, n.d AS d FROM near),
kd AS (SELECT event_id, max(d) AS k_distance FROM edges GROUP BY event_id),
lrd AS (
  SELECT e.event_id, 1 / (avg(greatest(d, k_distance)) + 1e-10) AS density
  FROM edges e JOIN kd ON kd.event_id = e.nid GROUP BY e.event_id),
lof AS (
  SELECT e.event_id, avg(n.density) / any_value(o.density) AS lof
  FROM edges e JOIN lrd n ON n.event_id = e.nid JOIN lrd o ON o.event_id = e.event_id GROUP BY e.event_id),
marked AS (SELECT event_id, lof, lof > (SELECT -quantile_cont(-lof, 0.05) FROM lof) AS is_anomaly FROM lof)"""

_CURVE = """WITH counts AS (
  SELECT n_chars::DOUBLE AS threshold, count(*) FILTER (quality = 0) AS positives, count(*) FILTER (quality <> 0) AS negatives
  FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY n_chars),
curve AS (
  SELECT *, CAST(sum(positives) OVER w AS BIGINT) AS true_positives, CAST(sum(negatives) OVER w AS BIGINT) AS false_positives,
    sum(positives) OVER () AS p, sum(negatives) OVER () AS n FROM counts WINDOW w AS (ORDER BY threshold DESC))"""


ORACLES: dict[str, str] = {
    "parse_generic": _select(_GENERIC, "generic"),
    "parse_syslog": _select(_SYSLOG, "syslog"),
    "parse_apache": _select(_APACHE, "apache_combined"),
    "parse_by_line": f"""WITH e AS (SELECT *, {_SHAPE} AS shape FROM events)
SELECT event_id, {_by_shape("timestamp")}, {_by_shape("level")}, {_by_shape("source")}, {_by_shape("message")},
  shape <> 'none' AS parsed, CASE shape WHEN 'none' THEN 'generic' ELSE shape END AS fmt FROM e""",
    "parse_fallback_stats": f"""WITH {_VOTES}
SELECT file, count(*) AS total_lines, count(*) FILTER (shape = fmt) AS parsed_lines, any_value(fmt) AS fmt_detected,
  count(*) FILTER (shape = fmt) / count(*) AS parse_rate, CAST(0 AS BIGINT) AS empty_messages
FROM head JOIN won USING (file) GROUP BY file""",
    "detect_format": f"WITH {_VOTES} SELECT * FROM won",
    "document_lines": r"""WITH pieces AS (
  SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents),
lines AS (SELECT doc_id, unnest(range(len(a))) AS i, a FROM pieces)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS source,
  a[i + 1] AS message, false AS parsed FROM lines WHERE regexp_matches(a[i + 1], '\S')""",
    "text_files": f"SELECT * EXCLUDE (event_id) FROM ({_select(_GENERIC, 'generic')})",
    "csv_files": f"SELECT {_CSV_FIELDS}",
    "csv_quoted_blocks": f"SELECT {_CSV_FIELDS}",
    "csv_canonicalise": f"SELECT {_CSV_FIELDS}",
    "log_folder": f"""WITH {_LOGS}
SELECT CASE WHEN level = 'ERROR' THEN date_trunc('second', timestamp) ELSE timestamp END AS timestamp,
  level, source, message, CASE WHEN level = 'ERROR' THEN 'generic' ELSE 'csv' END AS fmt FROM logs""",
    "row_limit": f"WITH {_LOGS} SELECT * EXCLUDE (value) FROM logs ORDER BY event_id LIMIT (SELECT count(*) // 3 FROM events)",
    "csv_missing_columns": """SELECT CAST(NULL AS TIMESTAMP) AS timestamp, 'INFO' AS level, 'unknown' AS source,
  CASE WHEN event_type <> 'view' THEN coalesce(props, '') ELSE '' END AS message, true AS parsed FROM events""",
    "bad_bytes": f"""SELECT CAST({_SECOND} AS TIMESTAMP) AS timestamp, 'svc' AS source,
  concat(event_id, CASE WHEN event_id % 3 = 0 THEN chr(65533) ELSE '' END, '.') AS message FROM events""",
    "input_guard": f"""WITH {_LOGS}
SELECT CASE level WHEN 'INFO' THEN 'text' WHEN 'WARN' THEN 'csv' END AS kind,
  CASE WHEN level = 'ERROR' THEN concat('unsupported file type ', chr(39), '.json', chr(39)) END AS reason,
  count(*) > 0 AS found, sum(length(message)) > 0 AS bytes
FROM logs WHERE level IN ('INFO', 'ERROR', 'WARN') GROUP BY level""",
    "null_time_windows": f"""WITH {_LOGS}, part AS (
  SELECT event_id, timestamp, source FROM logs WHERE event_id % 7 <> 0 AND event_id % 11 <> 0),
{_GAPS.replace("FROM logs", "FROM part")},
counts AS ({_rows_until("INTERVAL 59999999 MICROSECONDS", "part")})
SELECT event_id, CAST(gap AS DOUBLE) AS gap_seconds, coalesce(trailing_count, 0.0::DOUBLE) AS trailing_count
FROM logs LEFT JOIN gaps USING (event_id) LEFT JOIN counts USING (event_id)""",
    "csv_times": """SELECT event_id, CAST(CASE event_id % 10 WHEN 7 THEN date_trunc('day', ts) WHEN 9 THEN NULL
  ELSE date_trunc('second', ts) - CASE event_id % 10 WHEN 1 THEN INTERVAL 2 HOUR WHEN 3 THEN INTERVAL (-5) HOUR
    ELSE INTERVAL 0 HOUR END END AS TIMESTAMP) AS timestamp FROM events""",
    "calendar_features": """SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour,
  CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend
FROM events""",
    "severity_of_level": f"""WITH {_LOGS} SELECT event_id,
  CAST(CASE level WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'WARN' THEN 2 ELSE 1 END AS DOUBLE) AS severity FROM logs""",
    "gap_same_source": f"""WITH {_LOGS}, {_GAPS}
SELECT event_id, CAST(coalesce(gap, (SELECT median(gap) FROM gaps)) AS DOUBLE) AS gap_seconds FROM gaps""",
    "rolling_count_60s": f"WITH {_LOGS} " + _rows_until("INTERVAL 59999999 MICROSECONDS"),
    "rolling_count_3600s": f"WITH {_LOGS} " + _rows_until("INTERVAL 3599999999 MICROSECONDS"),
    "rolling_ties": _TIES,
    "rolling_hot_source": _TIES,
    "message_lengths": "SELECT doc_id, CAST(length(text) AS DOUBLE) AS message_length FROM documents",
    "truncate_messages": "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '…') "
    "ELSE coalesce(text, '') END AS message FROM documents",
    "standardise_features": f"{_FEATURES} SELECT event_id, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _SCALED)
    + " FROM features",
    "tokens": f"WITH {_TERMS} SELECT doc_id, term, count(*) AS tf FROM uses GROUP BY doc_id, term",
    "term_frequencies": f"WITH {_TERMS} SELECT * FROM frequencies",
    "vocabulary": f"WITH {_TERMS} SELECT term, term_idx, corpus_freq, doc_freq FROM vocabulary",
    "tfidf_weights": f"WITH {_WEIGHTS} SELECT doc_id, term, tf, round(weight, 7) AS weight FROM weights",
    "gram_matrix": f"""WITH {_WEIGHTS}
SELECT a.term_idx AS i, b.term_idx AS j, round(sum(a.weight * b.weight), 4) AS value
FROM weights a JOIN weights b ON a.doc_id = b.doc_id AND a.term_idx <= b.term_idx GROUP BY 1, 2""",
    "forest_sample": _SAMPLE,
    "forest_score_fixed": _FIXED,
    "score_rescale": f"WITH {_Z} SELECT event_id, anomaly_score FROM flagged",
    "contamination_flags": f"WITH {_Z} SELECT event_id, is_anomaly FROM flagged",
    "contamination_counts": f"WITH {_Z} "
    + " UNION ALL ".join(
        f"SELECT {s}::DOUBLE AS contamination, count(*) FILTER (raw > (SELECT -quantile_cont(-raw, {s}) FROM z)) AS flagged, "
        "count(*) AS total FROM z"
        for s in SHARES
    ),
    "exact_thresholds": " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice::DOUBLE, {p}), 6) AS value FROM lineitem"
        for p in (0.01, 0.05, 0.5, 0.95, 0.999)
    ),
    "forest_nodes": f"{_TREES} SELECT * REPLACE (round(threshold, 9) AS threshold) FROM nodes",
    "forest_scores": f"{_SCORES} SELECT event_id, raw AS raw_score FROM scores",
    "detection_counts": f"""{_SCORES}, marked AS (
  SELECT *, raw > (SELECT -quantile_cont(-raw, 0.05) FROM scores) AS f,
    100 * (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS share FROM scores)
SELECT count(*) AS events, count(*) FILTER (f) AS flagged, CAST(sum(event_id) FILTER (f) AS BIGINT) AS flagged_ids,
  round(avg(share), 2) AS mean_score, round(min(share), 2) AS lowest, round(max(share), 2) AS highest FROM marked""",
    "model_roundtrip": "SELECT count(*) AS events, count(*) AS equal_scores FROM events",
    "run_summary": f"""WITH {_Z} SELECT count(*) AS total_events, count(*) FILTER (is_anomaly) AS anomaly_count,
  round_even(count(*) FILTER (is_anomaly) / count(*) * 100, 2) AS anomaly_rate, 'csv' AS detected_format,
  100.0::DOUBLE AS parse_rate FROM flagged""",
    "level_counts": f"WITH {_LOGS} SELECT level, count(*) AS count FROM logs GROUP BY level",
    "top_anomalies": f"WITH {_Z} SELECT * FROM flagged WHERE is_anomaly ORDER BY anomaly_score DESC, event_id LIMIT 25",
    "top_events": f"WITH {_Z} SELECT event_id, timestamp, level, anomaly_score FROM flagged "
    "ORDER BY anomaly_score DESC, event_id LIMIT 10",
    "preview": f"WITH {_LOGS} SELECT * EXCLUDE (value) FROM logs ORDER BY event_id LIMIT 5",
    "plot_series": f"""WITH {_Z} SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_index, anomaly_score,
  is_anomaly, level, source, message FROM flagged""",
    "time_order": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS event_index FROM events",
    "results_csv": f"""WITH {_Z}
SELECT timestamp, level, source, {_SHORT} AS message, anomaly_score, is_anomaly FROM flagged""",
    "label_metrics": f"""WITH cut AS (SELECT -quantile_cont(-n_chars::DOUBLE, 0.1) AS c FROM documents),
joined AS (
  SELECT n_chars > c AS f, quality = 0 AS y FROM documents JOIN labels USING (doc_id), cut), {_METRICS}""",
    "lof_embeddings": _LOF,
    "flag_agreement": """WITH sums AS (
  SELECT l_orderkey, sum(l_quantity)::DOUBLE AS a, max(l_extendedprice)::DOUBLE AS b FROM lineitem GROUP BY 1),
cuts AS (SELECT -quantile_cont(-a, 0.05) AS ca, -quantile_cont(-b, 0.05) AS cb FROM sums)
SELECT count(*) AS events, count(*) FILTER (a > ca) AS left_flagged, count(*) FILTER (b > cb) AS right_flagged,
  count(*) FILTER (a > ca AND b > cb) AS flagged_by_both FROM sums, cuts""",
    "stream_sliding_counts": _STREAM,
    "stream_windows": f"""WITH {_LOGS}, {_GAPS}, counts AS ({_rows_until("INTERVAL 59999999 MICROSECONDS")})
SELECT event_id, CAST(gap AS DOUBLE) AS gap_seconds, trailing_count FROM gaps JOIN counts USING (event_id)""",
    "lof_events": f"""{_FEATURES}, matrix AS (SELECT event_id, [{_ROUNDED}] AS x FROM features), {_EVENT_LOF}
SELECT event_id, round(lof, 5) AS lof, is_anomaly FROM marked""",
    "detector_agreement": f"""{_SCORES}, {_EVENT_LOF},
forest AS (SELECT event_id, raw > (SELECT -quantile_cont(-raw, 0.05) FROM scores) AS f FROM scores)
SELECT count(*) AS events, count(*) FILTER (f) AS left_flagged, count(*) FILTER (is_anomaly) AS right_flagged,
  count(*) FILTER (f AND is_anomaly) AS flagged_by_both FROM forest JOIN marked USING (event_id)""",
    "precision_recall": f"""{_CURVE}
SELECT threshold, positives, negatives, true_positives, false_positives,
  round(true_positives / (true_positives + false_positives), 9) AS precision, round(true_positives / p, 9) AS recall FROM curve""",
    "ranking_quality": f"""{_CURVE}
SELECT CAST(any_value(p) AS BIGINT) AS positives, CAST(any_value(n) AS BIGINT) AS negatives,
  round(sum(positives * true_positives / (true_positives + false_positives)) / any_value(p), 9) AS average_precision,
  round(sum(negatives * (true_positives - positives / 2)) / (any_value(p) * any_value(n)), 9) AS roc_area FROM curve""",
    "svd_identities": f"""WITH {_TERMS}
SELECT CAST(unnest(range(8)) AS INTEGER) AS component, 1.0::DOUBLE AS energy, 0.0::DOUBLE AS largest_cross, true AS only_stretched,
  round((SELECT count(DISTINCT doc_id) FROM uses WHERE term NOT IN ({_STOP}))::DOUBLE, 5) AS squared_weights""",
    "stream_scores": f"WITH {_LOGS} SELECT level, count(*) AS events, count(*) AS equal_scores, count(*) AS equal_flags FROM logs GROUP BY level",
    "stream_late_windows": f"""WITH {_LOGS}, {_GAPS}, counts AS ({_rows_until("INTERVAL 59999999 MICROSECONDS")})
SELECT event_id, CAST(gap AS DOUBLE) AS gap_seconds, trailing_count FROM gaps JOIN counts USING (event_id)""",
    "no_times": """SELECT event_id, 0.0::DOUBLE AS seconds_since_prev_same_source, 0.0::DOUBLE AS events_per_min_same_source,
  -1.0::DOUBLE AS hour, -1.0::DOUBLE AS day_of_week, 0.0::DOUBLE AS is_weekend FROM events""",
}
