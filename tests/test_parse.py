import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vigil.functions import text as texts
from vigil.functions.numbers import fixed, round_exact
from vigil.functions.parse import parse_timestamp
from vigil.sources import spool

LINES = {
    '{"a":1}': True,
    '  {"a":1}\t': True,
    "　\x0b{\"a\":1}\xa0": True,
    '{"a":1} x': False,
    '{"a":1},{"b":2}': False,
    '{"a":1}] {"b":2}': False,
    '{"a":1}]{"b":2}': False,
    '{"a":1}}': False,
    '{"a":1}} , {"b":2}': False,
    '{"a":[{"b":1}]}': True,
    '{"a":"}] {"}': True,
    '{"a":1,"a":2}': True,
    "[1]": False,
    "5": False,
    "null": False,
    '"{}"': False,
    "not-json": False,
    "{'a':1}": False,
    "{}": True,
    "": None,
    "   ": None,
}


def test_lines_hold_exactly_one_object(spark):
    table = spark.createDataFrame([(k,) for k in LINES], "line string")
    for row in spool.parse_lines(table).collect():
        want = LINES[row["line"]]
        assert (row["obj"] is not None) is bool(want), row["line"]
        assert row["is_invalid"] is (want is False), row["line"]


def test_lenient_fields(spark):
    def parsed(**sections):
        table = spark.createDataFrame([(json.dumps(sections),)], "line string")
        return spool.reports_of(spool.parse_lines(table)).first()

    seqs = {5: 5, 3.9: 3, "5": 5, "3.9": None, True: 1, None: None, "x": None}
    for given, want in list(seqs.items())[:4] + [(True, 1), (None, None), ("x", None)]:
        assert parsed(timing={"seq": given})["seq"] == want, given
    nodes = [("n", "n"), ("", "unknown"), (None, "unknown"), (0, "unknown"), (False, "unknown"),
             ("0", "0"), (7, "7")]
    for given, want in nodes:
        assert parsed(identity={"node_id": given})["node_id"] == want, given
    assert parsed(identity="n")["node_id"] == "unknown"
    assert parsed(assessment={"reasons": ["b", "a"]})["reasons"] == ["b", "a"]
    assert parsed(assessment={"reasons": "b"})["reasons"] == []
    row = parsed(signals={"loadavg_1m": "9", "mem_total_bytes": 7, "disk_free_bytes": True,
                          "loadavg_5m": 2, "heartbeat_ok": 1})
    assert row["loadavg_1m"] is None and row["disk_free_bytes"] is None
    assert row["mem_total_bytes"] == 7 and row["loadavg_5m"] == 2.0
    assert row["heartbeat_ok"] is None


def test_last_repeated_key_wins(spark):
    table = spark.createDataFrame([('{"timing":{"seq":1,"seq":2}}',)], "line string")
    assert spool.reports_of(spool.parse_lines(table)).first()["seq"] == 2


@pytest.mark.parametrize(
    "text, ok",
    [
        ("2026-01-01T00:00:00+00:00", True),
        ("2026-01-01T00:00:00Z", True),
        ("2026-01-01 00:00:00.123456789", True),
        ("2026-01-01T00:00:00,5-05:30", True),
        ("2026-01-01", True),
        ("2026-01-01T10:15", True),
        ("2026-02-30", False),
        ("2026-01-01T25:00:00", False),
        ("2026", False),
        ("T12:00", False),
        ("0000-01-01", False),
        ("yesterday", False),
        ("", False),
        (None, False),
    ],
)
def test_timestamps(spark, text, ok):
    table = spark.createDataFrame([(text,)], "t string")
    assert (table.select(parse_timestamp(F.col("t"))).first()[0] is not None) is ok


def test_times_equal_the_standard_library(spark):
    """Every combination of date, separator, time and offset is read, or refused, as Python does."""
    dates = ["2026-02-28", "20260228", "2026-W09-6", "2026W096", "2026-W53", "2025-W53-1", "2020W537", "2026-02-30",
             "2026-13-01", "2026-0228", "202602", "2026-W00-1", "0001-01-01", "2026-W01-8", "2026W01-1"]
    times = ["", "T09", "T0930", "T09:30", "T093005", "T09:30:05", "T09:30:05.1", "T093005,1234567", " 23:59:59.999999",
             "_10:00", "T24:30", "T9:30", "T09:3005", "T0930:05", "T", "T09:30:05."]
    offsets = ["", "Z", "+05", "-0530", "+05:30", "+23:59", "-24:00", "+05:30:15", "+053015", "+05:60", "z", "+5"]
    texts = [d + t + o for d in dates for t in times for o in (offsets if t else [""])]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.t: r.m for r in table.select("t", F.unix_micros(parse_timestamp(F.col("t"))).alias("m")).collect()}
    start = datetime(1970, 1, 1, tzinfo=timezone.utc)
    wrong = []
    for text in texts:
        try:
            told = datetime.fromisoformat(text)
            told = told if told.tzinfo else told.replace(tzinfo=timezone.utc)
            wanted = (told - start) // timedelta(microseconds=1)
        except ValueError:
            wanted = None
        if found[text] != wanted:
            wrong.append(text)
    assert not wrong, wrong


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 1.005, 0.125, 0.375, -2.675, 1e9 + 0.3, 0.0, 4.5, 2.987654, -0.001]
    values += [i / 1000 for i in range(-300, 300, 7)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for row in table.select(
        "x",
        round_exact(F.col("x"), 2).alias("r"),
        fixed(F.col("x"), 2).alias("f"),
        fixed(F.col("x"), 2, signed=True).alias("s"),
    ).collect():
        assert row["r"] == round(row["x"], 2)
        assert row["f"] == f"{row['x']:.2f}"
        assert row["s"] == f"{row['x']:+.2f}"


def test_text_forms(spark):
    table = spark.createDataFrame([("x" * 203, None, 12 * 1024**3, 1024**3 + 1)], "m string, n bigint, a bigint, b bigint")
    row = table.select(
        texts.truncate_message(F.col("m")).alias("m"),
        texts.format_gb(F.col("a")).alias("a"),
        texts.format_gb_compact(F.col("b")).alias("b"),
        texts.format_gb(F.col("n")).alias("n"),
        texts.display_seq(F.col("n")).alias("seq"),
        texts.reason_label(F.lit("signal:cpu_high")).alias("known"),
        texts.reason_label(F.lit("other")).alias("other"),
    ).first()
    assert row["m"] == "x" * 200 + "...[truncated 3 chars]"
    assert tuple(row)[1:] == ("12 GB", "1.0G", "n/a", "unknown", "CPU load high", "other")
