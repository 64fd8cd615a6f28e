import random

import pytest
from plain import ROWS_SCHEMA, assert_summaries, report, rows, summaries
from pyspark.sql import functions as F

from vigil.operators import fleet
from vigil.operators.summarize import latest_reports, summarize_by_node, top_reasons
from vigil.operators.tail import large_tails, tail_rows


def made_up(seed, count=600, nodes=6):
    """Reports in which one node holds a third of all rows; times and seqs tie often."""
    rng = random.Random(seed)
    result = []
    for place in range(count):
        node = "hot" if rng.random() < 0.34 else f"n{rng.randrange(nodes)}"
        signals = {}
        if rng.random() < 0.8:
            signals["loadavg_1m"] = rng.randrange(0, 2000) / 160
        if rng.random() < 0.8:
            signals["mem_total_bytes"] = 16 * 1024**3
            signals["mem_available_bytes"] = rng.randrange(16 * 1024**3)
        if rng.random() < 0.8:
            signals["disk_total_bytes"] = rng.choice([0, 10**12])
            signals["disk_free_bytes"] = rng.randrange(10**12)
        at = f"2026-01-01T{rng.randrange(3):02d}:{place // 10:02d}:00+00:00"
        tags = [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
        health = rng.choice(["OK", "DEGRADED", "UNHEALTHY"])
        result.append(report(node, health, rng.randrange(1, 4), at, tags, f"b{place}", **signals))
    return result


def table_of(spark, reports):
    table = spark.createDataFrame(list(rows(reports)), ROWS_SCHEMA).repartition(5)
    return table.withColumn("piece", F.floor(F.col("place") / 37))


def test_against_plain_python(spark):
    for seed in (1, 2):
        reports = made_up(seed)
        table = table_of(spark, reports)
        for segment in (None, "piece"):
            got = summarize_by_node(table, 3, ["place"], segment)
            assert_summaries(got, summaries(reports, 3))
    assert_summaries(summarize_by_node(table, None, ["place"]), summaries(reports, None))
    assert_summaries(summarize_by_node(table, 0, ["place"], "piece"), summaries(reports, None))


def test_tail_of_each_node(spark):
    reports = made_up(3)
    table = table_of(spark, reports)
    want = []
    for node in {r["identity"]["node_id"] for r in reports}:
        want += [r for r in reports if r["identity"]["node_id"] == node][-20:]
    kept = tail_rows(table, 20, ["node_id"], ["place"])
    assert_summaries(summarize_by_node(kept, 5, ["place"]), summaries(want))
    assert tail_rows(table, 0, ["node_id"], ["place"]).count() == 0


def test_tail_cuts_rows_before_each_shuffle(spark):
    table = table_of(spark, made_up(4))
    plan = tail_rows(table, 20, ["node_id"], ["place"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("WindowGroupLimit") == 4


def test_summary_adds_no_shuffle_after_the_tail(spark):
    table = table_of(spark, made_up(4))
    kept = tail_rows(table, 20, ["node_id"], ["place"])

    def shuffles(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert shuffles(summarize_by_node(kept, 5, ["place"])) == shuffles(kept) == 2


def test_first_arrival_wins_ties(spark):
    same = "2026-01-01T00:00:00+00:00"
    reports = [report("n", h, 1, same, boot=h) for h in ("OK", "DEGRADED", "UNHEALTHY")]
    table = table_of(spark, reports)
    assert summarize_by_node(table, 5, ["place"]).first()["current_health"] == "OK"
    assert summarize_by_node(table, 5, ["place"], "place").first()["current_health"] == "OK"
    assert latest_reports(table, ["place"]).first()["health"] == "OK"


def test_close_points_still_have_a_trend(spark):
    times = ("2026-02-11T18:04:58.875122+00:00", "2026-02-11T18:04:58.929521+00:00")
    reports = [report("n", "OK", i, t, disk_free_bytes=267978203136 - 8192 * i, disk_total_bytes=1)
               for i, t in enumerate(times)]
    trend = summarize_by_node(table_of(spark, reports), 5, ["place"]).first()["signal_trends"]
    assert trend["disk_free_bytes"]["direction"] == "declining"
    assert trend["disk_free_bytes"]["label"].startswith("declining (-0.50 GB/hr)")
    one = summarize_by_node(table_of(spark, reports[:1]), 5, ["place"]).first()
    assert one["signal_trends"] == {}


def test_top_reasons_order(spark):
    reports = [report("n", reasons=["b", "a", "c", "c"])]
    got = top_reasons(table_of(spark, reports), 2).orderBy("place").collect()
    assert [(r["reason"], r["count"]) for r in got] == [("c", 2), ("a", 1)]


def test_fleet_figures(spark):
    table = spark.createDataFrame(
        [("a", "OK", "h1"), ("b", "UNHEALTHY", "h2"), ("c", "DEGRADED", "h1"), ("d", "OK", None)],
        "node_id string, current_health string, thresholds_hash string",
    )
    assert tuple(fleet.fleet_rollup(table).first()) == (4, 2, 1, 1, True, True)
    assert tuple(fleet.mixed_thresholds(table).first()) == (2, 3, "h1", True)
    assert fleet.alert_code(table).first()[0] == 3
    assert fleet.alert_code(table, filtered=False).first()[0] == 0
    nobody = table.limit(0)
    assert tuple(fleet.fleet_rollup(nobody).first()) == (0, 0, 0, 0, False, False)
    assert fleet.alert_code(nobody).first()[0] == 0
    assert fleet.mixed_thresholds(nobody).first()["mixed"] is False


@pytest.mark.parametrize("steps", [2, 7, 4096])
@pytest.mark.parametrize("n", [1, 40, 250, 10_000])
def test_large_tails(spark, n, steps):
    draw = random.Random(n)
    table = []
    for i in range(900):
        at = draw.choice([draw.randint(0, 30), draw.randint(0, 10**9), None if i % 50 == 0 else 5])
        table.append((draw.choice(["a", "a", "a", "b", None]), at, i))
    table += [("few", 3, 900), ("few", None, 901)]
    made = spark.createDataFrame(table, "k string, at long, i long")
    want = set()
    for key in {k for k, _, _ in table}:
        rows = sorted((r for r in table if r[0] == key), key=lambda r: (-1 if r[1] is None else r[1], r[2]))
        want |= {r[2] for r in rows[-n:]}
    found = [r.i for r in large_tails(made, n, ["k"], ["at", "i"], steps).collect()]
    assert len(found) == len(want) and set(found) == want


def test_large_tails_of_times_and_of_all_rows(spark):
    made = spark.range(1000).selectExpr("id", "timestamp_seconds(id * 7919 % 1009) AS at")
    want = {r.id for r in made.orderBy(F.desc("at"), F.desc("id")).limit(333).collect()}
    assert {r.id for r in large_tails(made, 333, [], ["at", "id"]).collect()} == want
    assert large_tails(made.limit(0), 5, [], ["at", "id"]).count() == 0


def test_tails_read_no_more_than_they_must(spark, tmp_path):
    """The beginning of all tails limits the scan, and filters on keys pass below the cut of a tail."""
    spark.range(5000).selectExpr("id", "id % 4 AS node").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = large_tails(table, 100, ["node"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id," in plan
    plan = tail_rows(table, 100, ["node"], ["id"]).where("node = 2")._jdf.queryExecution().executedPlan().toString()
    assert "(id#" in plan.split("PushedFilters")[0] and "% 4" not in plan and "EqualTo(node,2)" in plan
