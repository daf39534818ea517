import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from eventsift import enforce_row_limit, parse_csv_log, parse_log_file, parse_text_log, validate_input
from eventsift.functions.lines import LineFormat, line_formats
from eventsift.functions.times import csv_time
from eventsift.operators.parse import canonicalise, format_votes, parse_lines
from eventsift.sources.csv import SURPLUS, read_csv
from eventsift.sources.text import read_lines

GENERIC = [
    "2026-03-09 17:40:12 INFO  billing: invoice 88 sent",
    "2026-03-09 17:40:31 ERROR billing: invoice 89 bounced at the bank",
]
SYSLOG = "Mar  9 17:40:12 rack7 cron[51]: weekly report started"
APACHE = '10.3.0.9 - - [09/Mar/2026:17:40:12 +0000] "PUT /cart/3 HTTP/1.1" 409 77'
JUNK = "~~ watermelon, seven of them ~~"


def _file(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def _events(result):
    return sorted(result.events.collect(), key=lambda r: (r.file or "", r.block_start or 0, r.event_id))


def test_generic(spark, tmp_path):
    result = parse_text_log(spark, _file(tmp_path, "a.log", "\n".join(GENERIC)))
    rows = _events(result)
    assert [r.level for r in rows] == ["INFO", "ERROR"]
    assert {r.source for r in rows} == {"billing"}
    assert "invoice 88" in rows[0].message
    assert rows[0].timestamp == dt.datetime(2026, 3, 9, 17, 40, 12)
    total = result.totals().first()
    assert (total.total_lines, total.parsed_lines, total.fmt_detected, total.parse_rate) == (2, 2, "generic", 1.0)


def test_syslog(spark, tmp_path):
    path = _file(tmp_path, "a.log", SYSLOG)
    (row,) = _events(parse_text_log(spark, path))
    assert (row.source, row.level, row.timestamp) == ("rack7", "INFO", None)
    assert row.message == "cron[51]: weekly report started"
    (row,) = _events(parse_text_log(spark, path, syslog_year=2026))
    assert row.timestamp == dt.datetime(2026, 3, 9, 17, 40, 12)


def test_apache(spark, tmp_path):
    result = parse_text_log(spark, _file(tmp_path, "a.log", APACHE + ' "-" "agent \x01 x"'))
    (row,) = _events(result)
    assert (row.level, row.source) == ("WARN", "10.3.0.9")
    assert row.message == "PUT /cart/3 HTTP/1.1 status=409 size=77"
    assert row.timestamp == dt.datetime(2026, 3, 9, 17, 40, 12)
    assert result.stats().first().fmt_detected == "apache_combined"


def test_other_lines_are_kept(spark, tmp_path):
    result = parse_text_log(spark, _file(tmp_path, "a.log", JUNK))
    (row,) = _events(result)
    assert (row.message, row.level, row.source, row.timestamp, row.parsed) == (JUNK, None, None, None, False)
    assert result.totals().first().parsed_lines == 0


def test_empty_input(spark, tmp_path):
    result = parse_text_log(spark, _file(tmp_path, "a.log", "\n   \n"))
    assert result.events.count() == 0
    total = result.totals().first()
    assert (total.total_lines, total.fmt_detected, total.parse_rate) == (0, "empty", 0.0)
    assert "timestamp" in result.events.columns


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2026-03-09T17:40:12 notice {x}", ("INFO", "unknown", "{x}")),
        ("2026-03-09 17:40:12 warn é1-x.y: ", ("WARN", "é1-x.y", "")),
        ("2026-03-09 17:40:12 INFO src", ("INFO", "src", "")),
        ("2026-03-09 17:40:12\x1fINFO a:b: c", ("INFO", "a", "b: c")),
        ("2026-03-09 17:40:12 DEBUG a: tail \u0001 x", ("DEBUG", "a", "tail \u0001 x")),
    ],
)
def test_generic_details(spark, line, expected):
    lines = spark.createDataFrame([(0, line, "f")], "event_id long, value string, file string")
    (r,) = parse_lines(lines, fmt="generic").collect()
    assert r.parsed and (r.level, r.source, r.message) == expected


def test_bad_times_become_null(spark):
    texts = ["2026-13-01 17:40:12 INFO a: b", "2026-02-30 17:40:12 INFO a: b"]
    lines = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "event_id long, value string, file string")
    assert [(r.parsed, r.timestamp) for r in parse_lines(lines).collect()] == [(True, None)] * 2
    bad = APACHE.replace("09/Mar", "31/Mrz")
    lines = spark.createDataFrame([(0, bad, "f")], "event_id long, value string, file string")
    assert [(r.parsed, r.timestamp) for r in parse_lines(lines).collect()] == [(True, None)]


def test_line_ends_and_bad_bytes(spark, tmp_path):
    data = "a b\rc\r\nd\x0be\n\x1cf\u0085 \n".encode() + b"x\xffy\n"
    rows = read_lines(spark, _file(tmp_path, "a.log", data)).orderBy("event_id").collect()
    assert [r.value for r in rows] == data.decode("utf-8", errors="replace").split() == list("abcdef") + ["x�y"]


def test_votes_use_the_first_25_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    _file(folder, "a.log", "\n".join([SYSLOG] * 13 + GENERIC * 6 + GENERIC * 50))
    _file(folder, "b.log", "\n".join([APACHE] + [JUNK] * 40))
    _file(folder, "c.log", "\n".join([JUNK] * 3))
    _file(folder, "d.log", "\n".join([GENERIC[0], SYSLOG]))
    lines = read_lines(spark, str(folder))
    votes = {r.file[-5:]: r for r in format_votes(lines).collect()}
    assert {k: r.fmt for k, r in votes.items()} == {
        "a.log": "syslog", "b.log": "apache_combined", "c.log": "generic", "d.log": "generic",
    }
    assert (votes["a.log"].votes_syslog, votes["a.log"].votes_generic) == (13, 12)
    stats = {r.file[-5:]: r for r in parse_text_log(spark, str(folder)).stats().collect()}
    assert (stats["a.log"].total_lines, stats["a.log"].parsed_lines) == (125, 13)
    assert stats["b.log"].parse_rate == pytest.approx(1 / 41)


def test_vote_of_files_with_blank_blocks_and_of_many_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    # three blank blocks, then 24 lines of one layout and many of another
    _file(folder, "blank.log", "\n" * 30_000 + "\n".join([SYSLOG] * 24 + [APACHE] * 900))
    for i in range(60):
        _file(folder, f"s{i:02}.log", "\n".join([APACHE] * (i % 3) + [SYSLOG] * 2 + [GENERIC[0]] * 40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        votes = {r.file.rsplit("/")[-1]: r for r in format_votes(read_lines(spark, str(folder))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (votes["blank.log"].votes_syslog, votes["blank.log"].votes_apache_combined) == (24, 1)
    for i in range(60):
        r = votes[f"s{i:02}.log"]
        assert (r.votes_apache_combined, r.votes_syslog, r.votes_generic) == (i % 3, 2, 23 - i % 3)


def test_small_blocks_keep_order(spark, tmp_path):
    path = _file(tmp_path, "a.log", "\n".join(f"2026-03-09 17:40:12 INFO s: {i}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = read_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        rows = _events(parse_text_log(spark, path))
        first = enforce_row_limit(parse_text_log(spark, path).events, 1500).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.message) for r in rows] == list(range(3000))
    assert sorted(int(r.message) for r in first) == list(range(1500))


def test_custom_format(spark):
    extra = LineFormat(
        "pipe",
        r"^([^|]*)\|([^|]*)$",
        2,
        lambda g: {"timestamp": g[0].try_cast("timestamp_ntz"), "level": g[1], "source": g[1], "message": g[0]},
    )
    lines = spark.createDataFrame([(0, "x|y", "f"), (1, SYSLOG, "f")], "event_id long, value string, file string")
    rows = sorted(parse_lines(lines, [*line_formats(), extra], detect="line").collect())
    assert [(r.fmt, r.source) for r in rows] == [("pipe", "y"), ("syslog", "rack7")]


def test_csv(spark, tmp_path):
    path = _file(tmp_path, "sample.csv", "timestamp,level,source,message\n2026-03-09 17:40:12,INFO,shop,basket stored\n")
    result = parse_csv_log(spark, path)
    (row,) = _events(result)
    assert (row.message, row.fmt, row.level) == ("basket stored", "csv", "INFO")
    assert result.totals().first().parse_rate == 1.0


def test_csv_aliases_defaults_and_missing_cells(spark, tmp_path):
    text = ' Time ,SEVERITY,Host,Log,host2\n06/01/2026 10:30,notice,NA,"a ""q"",\nb",1\n1773078012,,web,,2\nnever,error,,null,3\n'
    rows = _events(parse_csv_log(spark, _file(tmp_path, "x.csv", text)))
    assert [(r.timestamp, r.level, r.source, r.message) for r in rows] == [
        (dt.datetime(2026, 6, 1, 10, 30), "NOTICE", "unknown", 'a "q",\nb'),
        (dt.datetime(2026, 3, 9, 17, 40, 12), "INFO", "web", ""),
        (None, "ERROR", "unknown", ""),
    ]


def test_csv_without_known_columns(spark, tmp_path):
    (row,) = _events(parse_csv_log(spark, _file(tmp_path, "x.csv", "a,b\n1,2\n")))
    assert (row.timestamp, row.level, row.source, row.message) == (None, "INFO", "unknown", "")


def test_first_alias_wins_and_epoch_units(spark):
    records = spark.createDataFrame([("1773078012000", "x", "y")], "Date string, msg string, text string")
    (row,) = canonicalise(records, "ms").collect()
    assert (row.timestamp, row.message) == (dt.datetime(2026, 3, 9, 17, 40, 12), "x")


def test_csv_repeated_names(spark, tmp_path):
    text = "Time,time,msg,msg,Log\n2026-06-01 00:00:00,2020-01-01 00:00:00,one,two,three\n"
    (row,) = _events(parse_csv_log(spark, _file(tmp_path, "x.csv", text)))
    assert (row.timestamp.year, row.message) == (2026, "one")


def test_csv_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _file(folder, "a.csv", "time,msg\n2026-06-01 00:00:00,one\n")
    _file(folder, "b.csv", "msg,level,time\ntwo,error,2026-06-02 00:00:00\n")
    _file(folder, "c.csv", "")
    rows = _events(parse_csv_log(spark, str(folder)))
    assert {(r.message, r.level, r.timestamp.day) for r in rows} == {("one", "INFO", 1), ("two", "ERROR", 2)}
    assert len({r.event_id for r in rows}) == 2


def test_large_csv_with_and_without_spanning_cells(spark, tmp_path):
    flat = _file(tmp_path, "flat.csv", "time,msg\n2026-06-01 00:00:00,one\n")
    span = _file(tmp_path, "span.csv", 'time,msg\n2026-06-01 00:00:00,"one\ntwo"\n')
    assert [r.msg for r in read_csv(spark, flat, one_task_bytes=10)[0].collect()] == ["one"]
    assert [r.msg for r in read_csv(spark, span, one_task_bytes=10)[0].collect()] == ["one\ntwo"]


@pytest.mark.parametrize("block, end", [(700, "\n"), (900, "\r\n")])
def test_quoted_line_breaks_are_cut_by_many_tasks(spark, tmp_path, monkeypatch, block, end):
    rng = random.Random(block)
    cells = ["", "plain", "a,b", "x\ny", "\n\n", 'say ""hi""', '""\n""', "long " * 20 + "\n" + "tail,\n" * 30, "w\r\nz", "x\n2026,\"\"q"]
    bare = ["", "7", '5"" pipe'.replace('""', '"'), 'a""b', " spaced "]
    lines = ["time,msg,other`s"]
    for i in range(150):
        row = [f"{i}", *(rng.choice(bare) if rng.random() < 0.4 else f'"{rng.choice(cells)}"' for _ in range(2))]
        lines.append(",".join(row + ["more"] * (i % 50 == 7)) + end * (i % 40 == 3))
    path = _file(tmp_path, "a.csv", end * 2 + end.join(lines))
    expected = read_csv(spark, path)[0].collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = []
        for rows in (200_000, 0):  # block states by broadcast and by a join
            monkeypatch.setattr("eventsift.sources.quoted._BROADCAST_BLOCKS", rows)
            (table,) = read_csv(spark, path, one_task_bytes=10)
            assert table.columns == ["time", "msg", "other`s", SURPLUS, "event_id", "file", "block_start"]
            found.append(sorted(table.collect(), key=lambda r: (r.block_start, r.event_id)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.block_start for r in found[0]}) > 7
    for rows in found:
        assert len({r.event_id for r in rows}) == len(rows)
        assert [tuple(r)[:4] for r in rows] == [tuple(r)[:4] for r in expected]


def test_a_quote_that_nothing_closes(spark, tmp_path, monkeypatch):
    path = _file(tmp_path, "a.csv", 'time,msg\n1,a\n2,"open\n3,b\n4,c')
    rows = sorted(read_csv(spark, path, one_task_bytes=10)[0].collect(), key=lambda r: r.event_id)
    assert [r.time for r in rows] == ["1", "2"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8")
    monkeypatch.setattr("eventsift.sources.quoted.MAX_RECORD_CHARS", 5)
    try:
        with pytest.raises(Exception, match="open for more than"):
            read_csv(spark, path, one_task_bytes=10)[0].collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dispatch_by_extension(spark, tmp_path):
    csv = _file(tmp_path, "sample.CSV", "timestamp,level,source,message\n2026-03-09 17:40:12,INFO,shop,basket stored\n")
    log = _file(tmp_path, "sample.LOG", GENERIC[0])
    other = _file(tmp_path, "sample.dat", SYSLOG)
    assert parse_log_file(spark, csv).totals().first().fmt_detected == "csv"
    assert parse_log_file(spark, log).totals().first().fmt_detected == "generic"
    assert parse_log_file(spark, other).totals().first().fmt_detected == "syslog"
    both = parse_log_file(spark, str(tmp_path)).events.collect()
    assert {r.fmt for r in both} == {"csv", "generic"}
    assert len({r.event_id for r in both}) == 2


def test_validate_input(spark, tmp_path):
    for name, data in (("a.log", "x"), ("b.TXT", ""), ("c.exe", "x"), ("d.csv", "x" * 50)):
        _file(tmp_path, name, data)
    got = {r.path[-5:]: r.reason for r in validate_input(spark, str(tmp_path), max_bytes=20).collect()}
    assert got == {
        "a.log": None, "b.TXT": "empty file", "c.exe": "unsupported file type '.exe'", "d.csv": "larger than 20 bytes",
    }
    assert all(r.reason is None or r.length == 0 or "exe" in r.reason for r in validate_input(spark, str(tmp_path)).collect())


def _texts(result):
    return sorted(r.message for r in result.events.collect())


def test_named_files_are_read_whatever_their_name(spark, tmp_path):
    paths = [_file(tmp_path, "x.csv", "time,msg\n2026-03-09 00:00:00,one\n"), _file(tmp_path, "app.log.1", "two\nthree\n")]
    paths.append(_file(tmp_path, "notes.out", "four\n"))
    result = parse_log_file(spark, paths)
    assert _texts(result) == ["four", "one", "three", "two"]
    assert result.rejected.count() == 0
    assert len({r.event_id for r in result.events.collect()}) == 4


@pytest.mark.parametrize("others", [1, 2])
def test_each_file_of_a_folder_is_judged_alone(spark, tmp_path, others):
    import gzip

    deep = tmp_path / "logs" / "2026" / "03"
    deep.mkdir(parents=True)
    _file(deep, "x.log", "nested\n")
    _file(tmp_path / "logs", "a.log", "top\n")
    _file(tmp_path / "logs", "b.log.gz", gzip.compress(b"packed\n"))
    _file(tmp_path / "logs" / "2026", "c.csv", "msg\nrecord\n")
    _file(tmp_path / "logs", "empty.txt", "")
    for i in range(others):
        _file(tmp_path / "logs", f"core{i}.out", "binary\n")
    result = parse_log_file(spark, str(tmp_path / "logs"))
    assert _texts(result) == ["nested", "packed", "record", "top"]
    reasons = sorted((r.path.rsplit("/", 1)[1], r.reason) for r in result.rejected.collect())
    assert reasons == [*[(f"core{i}.out", "unsupported file type '.out'") for i in range(others)], ("empty.txt", "empty file")]


def test_surplus_cells_are_kept(spark, tmp_path):
    text = 'time,source,msg\n2026-03-09 00:00:00,a,hello, world and more\n2026-03-09 00:00:01,b,"x, ""y"""\n2026-03-09 00:00:02,c\n'
    rows = sorted(parse_csv_log(spark, _file(tmp_path, "a.csv", text)).events.collect(), key=lambda r: r.timestamp)
    assert [(r.source, r.message, r.parsed) for r in rows] == [
        ("a", "2026-03-09 00:00:00,a,hello, world and more", False), ("b", 'x, "y"', True), ("c", "", True),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-03-09 08:00:00+02:00", "2026-03-09 06:00"),
        ("2026-03-09T08:00:00Z", "2026-03-09 08:00"),
        ("2026-03-09T08:00:00-0500", "2026-03-09 13:00"),
        ("2026-03-09 08:00:00", "2026-03-09 08:00"),
        ("2026-03-09", "2026-03-09 00:00"),
        ("09/Mar/2026:08:00:00 +0100", "2026-03-09 07:00"),
        ("Mar 9, 2026 08:00:00", "2026-03-09 08:00"),
        ("03/09/2026 08:00 PM", "2026-03-09 20:00"),
        ("20260309", "2026-03-09 00:00"),
        ("1773043200", "2026-03-09 08:00"),
        ("eight o'clock", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_csv_times(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(text,)], "t string")
        got = frame.select(csv_time(frame.t).cast("string").alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == (expected and f"{expected}:00")


def test_unsupported_named_file_is_an_error(spark, tmp_path):
    from eventsift import analyze
    from eventsift.sources.guard import UnsupportedInputError

    with pytest.raises(UnsupportedInputError, match="run.exe"):
        analyze(spark, _file(tmp_path, "run.exe", "x\n"))


def test_run_removes_its_tables(spark, tmp_path):
    import os

    from eventsift import analyze
    from eventsift.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    lines = "\n".join(f"2026-03-09 17:{i // 60:02d}:{i % 60:02d} INFO s{i % 3}: step {i} of the run" for i in range(300))
    with analyze(spark, _file(tmp_path, "a.log", lines)) as run:
        assert run.top(5).count() <= 5 and set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_relative_names_are_those_files_only(spark, tmp_path):
    here = spark._jvm.java.lang.System.getProperty("user.dir")
    for folder in ("", "in/sub"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "a.out").write_text(f"2026-06-01 08:00:00 INFO svc: from {folder or 'top'}\n")
    (tmp_path / "in" / "b +%.log").write_text("2026-06-01 08:00:01 INFO svc: second\n")
    relative = os.path.relpath(tmp_path / "a.out", here)
    found = parse_log_file(spark, [relative, str(tmp_path / "in")])
    assert sorted(r.message for r in found.events.collect()) == ["from top", "second"]
    assert [r.path.rsplit("/", 2)[-2:] for r in found.rejected.collect()] == [["sub", "a.out"]]
    odd = parse_log_file(spark, str(tmp_path / "in" / "b +%.log"))
    assert odd.events.count() == 1


def test_row_limits_without_files(spark):
    ids = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3001 * 2**40).alias("event_id"))
    everything = sorted(r.event_id for r in ids.collect())
    for n in (0, 1, 1234, 2999, 3000, 5000):
        assert sorted(r.event_id for r in enforce_row_limit(ids, n).collect()) == everything[:n]
