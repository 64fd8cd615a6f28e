"""The registry against its SQL; ``python -m suite.check`` runs all of it at any scale."""

import pytest

import __spark_entry__ as entry
from suite.check import actual, connect, differences, expected
from suite.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "verdict_by_profile",
    "threshold_layers",
    "node_summary",
    "node_history_summary",
    "parse_lines",
    "validation_errors",
    "validate_events",
    "assign_seq",
    "sustained_alerts",
    "render_explain",
    "summary_json",
    "spool_summary",
    "stream_outage_sessions",
]


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = actual(entry.queries()[name](spark, FOLDER))
    problem = differences(got, expected(connect(FOLDER), entry.oracle_sql()[name]))
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() == 15
