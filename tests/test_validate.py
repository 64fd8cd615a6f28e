import json

import pytest
from plain import line, report
from pyspark.sql import functions as F

from vigil.operators import validate
from vigil.plans import commands
from vigil.sources import event_log


def broken(**changes):
    """A valid report with some nested values replaced; None removes the key."""
    value = report("n", "OK", 1)
    for path, new in changes.items():
        *outer, last = path.split("__")
        place = value
        for key in outer:
            place = place[key]
        if new is None:
            place.pop(last)
        else:
            place[last] = new
    return line(value)


CASES = [
    (broken(), []),
    (broken(identity__boot_id=None), []),
    (broken(signals={}), []),
    ("not-json", ["invalid JSON"]),
    ('{"a":1} x', ["invalid JSON"]),
    ("[1]", ["expected JSON object, got list"]),
    ("3", ["expected JSON object, got int"]),
    ('"{}"', ["expected JSON object, got str"]),
    ("null", ["expected JSON object, got NoneType"]),
    (broken(signals=None, meta=None), ["missing required keys: ['meta', 'signals']"]),
    (broken(assessment__health="UNKNOWN"),
     ["assessment.health must be one of ['DEGRADED', 'OK', 'UNHEALTHY'], got 'UNKNOWN'"]),
    (broken(assessment__health="it's"),
     ["assessment.health must be one of ['DEGRADED', 'OK', 'UNHEALTHY'], got \"it's\""]),
    (broken(assessment__health=None),
     ["assessment.health must be one of ['DEGRADED', 'OK', 'UNHEALTHY'], got None"]),
    (broken(assessment__reasons="x"), ["assessment.reasons must be an array"]),
    (broken(meta__schema_version="2"), ["meta.schema_version must be '1', got '2'"]),
    (broken(meta__schema_version=1), ["meta.schema_version must be '1', got 1"]),
    (broken(timing__emitted_at="bad"), ["timing.emitted_at is not a valid RFC3339 timestamp: 'bad'"]),
    (broken(timing__seq=0), ["timing.seq must be an integer >= 1, got 0"]),
    (broken(timing__seq="1"), ["timing.seq must be an integer >= 1, got '1'"]),
    (broken(timing__seq=1.5), ["timing.seq must be an integer >= 1, got 1.5"]),
    (broken(identity__node_id=""), ["identity.node_id must be a non-empty string"]),
    (broken(identity__node_id=" \t"), ["identity.node_id must be a non-empty string"]),
    (broken(identity__node_id=5), ["identity.node_id must be a non-empty string"]),
    (broken(signals=[]), ["signals must be an object"]),
    (broken(timing__seq=0, assessment__health="x"),
     ["assessment.health must be one of ['DEGRADED', 'OK', 'UNHEALTHY'], got 'x'",
      "timing.seq must be an integer >= 1, got 0"]),
]


def test_report_contract(spark):
    table = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, line string")
    got = validate.validate_lines(table).orderBy("i").collect()
    for row, (text, want) in zip(got, CASES):
        assert row["errors"] == want, text
        assert row["is_valid"] is (want == [])


def test_tail_of_non_blank_lines(spark, tmp_path):
    good = [broken(timing__seq=i) for i in range(1, 60)]
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(["bad", "", *good, "", broken(timing__seq=0)]) + "\n\n")
    last = commands.validate_spool(spark, str(path), 1)
    assert tuple(validate.validation_counts(last).first()) == (0, 1, 1)
    two = commands.validate_spool(spark, str(path), 2)
    assert [r["line_no"] for r in validate.validation_errors(two).collect()] == [2]
    everything = commands.validate_spool(spark, str(path), 0)
    assert tuple(validate.validation_counts(everything).first()) == (59, 2, 2)
    errors = validate.validation_errors(everything).orderBy("line_no").collect()
    assert [(r["line_no"], r["message"][:10]) for r in errors] == [(1, "invalid JS"), (61, "timing.seq")]
    good_lines, bad_lines = validate.quarantine(everything)
    assert (good_lines.count(), bad_lines.count()) == (59, 2)


def event(kind="agent_tick", **fields):
    return json.dumps({"event_type": kind, "agent_version": "1", "utc_now": "2026-01-01T00:00:00Z", **fields})


@pytest.mark.parametrize(
    "text, want",
    [
        (event(mode="run", seq=1, interval_s=1, overrun=False, sleep_ms=0), []),
        (event(spool_max_bytes=None), []),
        (event("agent_nap"), ["unknown event_type: 'agent_nap'"]),
        (event(mode="x"), ["unknown mode: 'x'"]),
        (event(mode=3), ["mode must be a string"]),
        (event(seq=0), ["seq must be an integer >= 1"]),
        (event(sleep_ms=-1, overrun=1), ["overrun must be a boolean", "sleep_ms must be an integer >= 0"]),
        (event(utc_now="now"), ["utc_now is not a timestamp: 'now'"]),
        (event(agent_version=""), ["agent_version must be non-empty"]),
        ("{}", [f"missing required key: {k}" for k in ("agent_version", "event_type", "utc_now")]),
        ("[]", ["expected JSON object"]),
        ("nope", ["invalid JSON"]),
    ],
)
def test_event_contract(spark, text, want):
    table = spark.createDataFrame([(text,)], "line string")
    assert validate.validate_events(table).first()["errors"] == want


def test_event_log(spark):
    lines = [event("collector_failed", collector="cpu", error_type="OSError"), event("agent_nap"), "x"]
    table = spark.createDataFrame([(text,) for text in lines], "line string")
    events = event_log.parse_events(table)
    assert [(r["collector"], r["error_type"]) for r in events.collect()] == [("cpu", "OSError")]
