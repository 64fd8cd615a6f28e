"""Work on events that lie in one split is spread, and spools are parsed once."""

import datetime

import pytest
from pyspark.sql import functions as F

from suite import queries
from vigil.sources import ranges

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [
        (k, begin + datetime.timedelta(minutes=k), 7 * k, ("view", "error", "signup")[k % 3], k / 4, f'{{"k": {k % 100}}}') for k in range(200)
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_lines_of_one_split_are_made_by_many_tasks(spark, tables):
    lines = queries.report_lines(spark, tables)
    per_task = lines.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 200
    assert len(per_task) > 1


def test_appended_spool_is_parsed_once(spark, tables):
    found = queries.spool_appends(spark, tables)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("] text") == 0
    assert sum(r.reports_seen_tail for r in found.collect()) > 100


@pytest.mark.parametrize("last", [True, False])
def test_written_files_hold_their_lines_in_order(spark, tmp_path, last):
    rows = [(f"f{k % 7}", k, f"é{k}") for k in range(500)]
    table = spark.createDataFrame(rows, "name string, at long, line string").repartition(3)
    ranges.write_files(table, str(tmp_path / "out"), F.concat("name", F.lit(".jsonl")), ["at"], ending_of_last=last)
    for n in range(7):
        want = "\n".join(text for name, _, text in rows if name == f"f{n}") + ("\n" if last else "")
        assert (tmp_path / "out" / f"f{n}.jsonl").read_text("utf-8") == want
