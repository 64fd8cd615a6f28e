from pyspark.sql import functions as F

from vigil.operators.profiles import evaluate_by_profile, verdict_changes, verdict_matrix
from vigil.sources.thresholds import document_layers, read_documents, resolve_layers, thresholds_table

LAYERS = "profile string, layer string, section string, key string, value string"
def resolved(spark, rows):
    table = resolve_layers(spark.createDataFrame([("p", *r) for r in rows], LAYERS))
    return {(r["section"], r["key"]): (r["value"], r["source"]) for r in table.collect()}


def test_layers(spark):
    got = resolved(
        spark,
        [
            ("file", "cpu", "degraded_factor", "0.7"),
            ("env", "cpu", "degraded_factor", "0.75"),
            ("file", "mem", "degraded_pct", "15"),
            ("file", "mem", "unhealthy_pct", "9.5"),
            ("env", "disk", "degraded_pct", "much"),
            ("file", "disk", "own_key", "1"),
            ("file", "gpu", "degraded_pct", "1"),
            ("env", "disk", "own_env", "1"),
            ("env", "evaluation", "profile_name", "night"),
        ],
    )
    assert got == {
        ("cpu", "degraded_factor"): ("0.75", "env"),
        ("cpu", "unhealthy_factor"): ("1.25", "default"),
        ("mem", "degraded_pct"): ("15", "default"),
        ("mem", "unhealthy_pct"): ("9.5", "file"),
        ("disk", "degraded_pct"): ("10.0", "env"),
        ("disk", "unhealthy_pct"): ("5.0", "default"),
        ("disk", "own_key"): ("1", "file"),
        ("evaluation", "profile_name"): ('"night"', "env"),
    }


def test_documents(spark, tmp_path):
    """Threshold files: broken ones and odd sections fall back to defaults, the last of repeated members counts."""
    files = {
        "a": b'{"cpu": {"degraded_factor": 0.5, "degraded_factor": 0.60}, "disk": {"own key": "x\\"y", "on": true}}',
        "b": b'{"cpu": {"degraded_factor": 0.5}} trailing',
        "c": b'{"mem": 7, "gpu": {"degraded_pct": 1}, "disk": {}}',
        "d": b" ",
        "e": b'{"mem": {"degraded_pct": 9\xff}}',
        "f": b'\n {"mem": {"degraded_pct": 15, "unhealthy_pct": 1e1}}\n',
        "g": b"null",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_bytes(content)
    (tmp_path / "notes.txt").write_text("{}")
    table = resolve_layers(document_layers(read_documents(spark, str(tmp_path)))).collect()
    assert {r["profile"] for r in table} == set(files)
    own = {(r["profile"], r["section"], r["key"]): (r["value"], r["source"]) for r in table
           if r["source"] != "default" or r["profile"] == "f" and r["section"] == "mem"}
    assert own == {
        ("a", "cpu", "degraded_factor"): ("0.6", "file"),
        ("a", "disk", "own key"): ('"x\\"y"', "file"),
        ("a", "disk", "on"): ("true", "file"),
        ("f", "mem", "degraded_pct"): ("15", "default"),
        ("f", "mem", "unhealthy_pct"): ("10.0", "file"),
    }
    assert all(sum(r["profile"] == p for r in table) == 7 for p in "bcdeg")


def test_later_rows_of_a_layer_win(spark):
    rows = [("p", "file", "cpu", "degraded_factor", v, i) for i, v in enumerate(["0.9", "0.5", "0.7"])]
    for given in (rows, rows[::-1]):
        table = resolve_layers(spark.createDataFrame(given, LAYERS + ", position int"))
        assert table.where("key = 'degraded_factor' AND section = 'cpu'").first()["value"] == "0.7"


def test_hash(spark):
    rows = [("p", "file", "cpu", "degraded_factor", "0.5"), ("p", "file", "disk", "own", "1"),
            ("q", "file", "gpu", "x", "1")]
    table = thresholds_table(resolve_layers(spark.createDataFrame(rows, LAYERS)))
    found = {r["profile"]: r for r in table.collect()}
    assert found["p"]["thresholds_hash"] == "50acf7e1717deca3"
    assert found["q"]["thresholds_hash"] == "75a56ad7637c31b2"
    assert found["p"]["cpu_degraded_factor"] == 0.5 and found["q"]["profile_name"] == "default"


def test_env_numbers_are_plain(spark):
    given = ["0.5d", "0.5f", "1e1", " 7 ", "x", "NaN"]
    layers = [(f"p{i}", "env", "mem", "degraded_pct", v) for i, v in enumerate(given)]
    table = thresholds_table(resolve_layers(spark.createDataFrame(layers, LAYERS)))
    got = {r["profile"]: r["mem_degraded_pct"] for r in table.collect()}
    assert [got[f"p{i}"] for i in range(6)] == [15.0, 15.0, 10.0, 7.0, 15.0, 15.0]


def test_profiles_by_broadcast_and_by_shuffle(spark):
    layers = spark.createDataFrame([("strict", "file", "cpu", "degraded_factor", "0.1")], LAYERS)
    table = thresholds_table(resolve_layers(layers))
    rows = [(1, "strict", 2.0, 8), (2, "unknown", 2.0, 8), (3, None, 2.0, 8)]
    signals = spark.createDataFrame(
        rows, "id int, threshold_profile string, loadavg_1m double, cpu_count_logical int"
    ).withColumns({c: F.lit(None).cast("bigint") for c in
                   ("mem_total_bytes", "mem_available_bytes", "disk_total_bytes", "disk_free_bytes")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, join in ((50, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            judged = evaluate_by_profile(signals, table, limit=limit)
            assert join in judged._jdf.queryExecution().executedPlan().toString()
            got = {r["id"]: r["health"] for r in judged.collect()}
            assert got == {1: "DEGRADED", 2: "OK", 3: "OK"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changes = verdict_changes(judged, {"cpu_unhealthy_factor": 0.2})
    got = {(r["health"], r["new_health"]): r["reports"] for r in verdict_matrix(changes).collect()}
    assert got == {("DEGRADED", "UNHEALTHY"): 1, ("OK", "UNHEALTHY"): 2}
