import pytest
from pyspark.sql import functions as F

from vigil.functions.health import evaluate, failure_reasons, verdict
from vigil.functions.reports import assemble, builder_error, checked, report_json

SCHEMA = (
    "id int, loadavg_1m double, cpu_count_logical int, mem_total_bytes bigint,"
    " mem_available_bytes bigint, disk_total_bytes bigint, disk_free_bytes bigint"
)
CPU, MEM, DISK = "signal:cpu_", "signal:mem_available_", "signal:disk_free_"


def judge(spark, cases, thresholds=None, **options):
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], SCHEMA)
    found = evaluate(table, thresholds, **options).orderBy("id").collect()
    return [(r["health"], r["reasons"]) for r in found]


def test_all_critical(spark):
    reasons = [CPU + "critical", DISK + "critical", MEM + "critical"]
    assert judge(spark, [(10.0, 4, 100, 5, 100, 4)]) == [("UNHEALTHY", reasons)]


def test_limits_are_strict(spark):
    cases = [
        (8 * 0.85, 8, None, None, None, None),
        (8 * 1.25, 8, None, None, None, None),
        (8 * 1.25 + 0.01, 8, None, None, None, None),
        (None, None, 100, 15, None, None),
        (None, None, 100, 8, None, None),
        (None, None, 1000, 79, None, None),
        (None, None, None, None, 100, 10),
        (None, None, None, None, 100, 5),
        (None, None, None, None, 1000, 49),
    ]
    assert judge(spark, cases) == [
        ("OK", []),
        ("DEGRADED", [CPU + "high"]),
        ("UNHEALTHY", [CPU + "critical"]),
        ("OK", []),
        ("DEGRADED", [MEM + "low"]),
        ("UNHEALTHY", [MEM + "critical"]),
        ("OK", []),
        ("DEGRADED", [DISK + "low"]),
        ("UNHEALTHY", [DISK + "critical"]),
    ]


def test_missing_or_zero_signals_are_skipped(spark):
    cases = [(9.0, 0, 0, 5, 0, 5), (9.0, None, None, 1, None, 1), (None, 4, 100, None, 100, None)]
    assert judge(spark, cases) == [("OK", [])] * 3


def test_own_thresholds(spark):
    quiet = (0.1, 8, None, None, None, None)
    disk = (None, None, None, None, 100, 6)
    assert judge(spark, [quiet], {"cpu_degraded_factor": 0.001}) == [("DEGRADED", [CPU + "high"])]
    assert judge(spark, [disk], {"disk_unhealthy_pct": 8}) == [("UNHEALTHY", [DISK + "critical"])]
    assert judge(spark, [disk]) == [("DEGRADED", [DISK + "low"])]


def test_failures_and_unknown_tags(spark):
    table = spark.createDataFrame(
        [
            (["b", "a", "a"], "OK"),
            (["collector_failed:cpu"], "DEGRADED"),
            (["x_critical"], "UNHEALTHY"),
            (["signal:own"], "DEGRADED"),
            ([], "OK"),
        ],
        "tags array<string>, want string",
    )
    for row in table.select("want", verdict(F.col("tags")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_failure_reasons(spark):
    outcomes = [(n, False) for n in ("identity", "heartbeat", "cpu", "memory", "disk", "network")]
    table = spark.createDataFrame(
        [(outcomes, None), ([("cpu", True)], "b")],
        "outcomes array<struct<name:string,ok:boolean>>, boot_id string",
    )
    got = table.select(failure_reasons(F.col("outcomes"), F.col("boot_id")).alias("t")).collect()
    tags = ["heartbeat", "cpu", "memory", "disk", "identity"]
    assert got[0]["t"] == [f"collector_failed:{t}" for t in tags]
    assert got[1]["t"] == []


def test_extra_rule(spark):
    rule = ("signal:many_cores_critical", F.col("cpu_count_logical") > 4)
    assert judge(spark, [(0.1, 8, None, None, None, None)], extra_rules=[rule]) == [
        ("UNHEALTHY", ["signal:many_cores_critical"])
    ]


def test_report_json_is_canonical(spark):
    table = spark.createDataFrame(
        [("n", None, "t", 1, "OK", ["b", "a"], None, 2.5)],
        "node_id string, boot_id string, emitted_at string, seq bigint, health string,"
        " reasons array<string>, heartbeat_ok boolean, loadavg_1m double",
    )
    text = assemble(table).select(report_json(F.col("report")).alias("j")).first()["j"]
    assert text == (
        '{"assessment":{"health":"OK","reasons":["a","b"]},"identity":{"node_id":"n"},'
        '"meta":{"agent_version":"0.1.0","schema_version":"1","threshold_profile":"default",'
        '"thresholds_hash":""},"signals":{"loadavg_1m":2.5},"timing":{"emitted_at":"t","seq":1}}'
    )


def test_builder_rejects_bad_reports(spark):
    table = spark.createDataFrame(
        [("n", "b", "t", 0, "OK", [], True)],
        "node_id string, boot_id string, emitted_at string, seq bigint, health string,"
        " reasons array<string>, heartbeat_ok boolean",
    )
    built = assemble(table)
    assert built.select(builder_error(F.col("report"))).first()[0] == "timing.seq must be >= 1"
    with pytest.raises(Exception, match="timing.seq must be >= 1"):
        checked(built).collect()
