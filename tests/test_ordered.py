import random

from pyspark.sql import functions as F

from vigil.operators import ordered
from vigil.operators.alerts import sustained_alerts
from vigil.operators.sequence import assign_seq, sequence_audit, sequence_steps
from vigil.operators.summarize import health_transitions
from vigil.operators.ticks import collector_totals, tick_timing


def history(seed, count=500):
    """Rows of several keys, one of them hot; values change seldom."""
    rng = random.Random(seed)
    value, result = {}, []
    for place in range(count):
        key = "hot" if rng.random() < 0.4 else rng.choice("abc")
        if rng.random() < 0.3 or key not in value:
            value[key] = rng.choice(["x", "y", "z"])
        result.append((key, place, place // rng.choice([23]), value[key]))
    return result


def table_of(spark, rows):
    return spark.createDataFrame(
        rows, "node_id string, place bigint, piece bigint, value string"
    ).repartition(7)


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


def test_previous_row(spark):
    rows = history(1)
    got = ordered.with_previous(table_of(spark, rows), ["node_id"], ["place"], "piece", ["value", "place"])
    found = {r["place"]: (r["has_prev"], r["prev_value"], r["prev_place"]) for r in got.collect()}
    assert len(found) == len(rows)
    for mine in by_key(rows).values():
        for before, row in zip([None, *mine], mine):
            want = (False, None, None) if before is None else (True, before[3], before[1])
            assert found[row[1]] == want


def test_run_position_and_numbers(spark):
    rows = history(2)
    table = table_of(spark, rows)
    position = {r["place"]: r["position"] for r in
                ordered.run_position(table, ["node_id"], ["place"], "piece", "value").collect()}
    number = {r["place"]: r["number"] for r in
              ordered.numbered(table, ["node_id"], ["place"], "piece").collect()}
    for mine in by_key(rows).values():
        run = 0
        for i, row in enumerate(mine):
            run = run + 1 if i and mine[i - 1][3] == row[3] else 1
            assert position[row[1]] == run
            assert number[row[1]] == i + 1


def test_rows_without_segment_come_first(spark):
    rows = [("n", i, None if i < 3 else i // 4, v) for i, v in enumerate("xxyyyxxx")]
    table = table_of(spark, rows)
    got = ordered.with_previous(table, ["node_id"], ["place"], "piece", ["value"])
    assert [r["prev_value"] for r in got.orderBy("place").collect()] == [None, *"xxyyyxx"]
    got = ordered.run_position(table, ["node_id"], ["place"], "piece", "value")
    assert [r["position"] for r in got.orderBy("place").collect()] == [1, 2, 1, 2, 3, 1, 2, 3]
    got = ordered.numbered(table, ["node_id"], ["place"], "piece")
    assert [r["number"] for r in got.orderBy("place").collect()] == list(range(1, 9))
    got = ordered.islands(table, ["node_id"], ["place"], "piece", "value", "place")
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 1, 2), (2, 4, 3), (5, 7, 3)]


def test_one_scan_and_shuffle_of_the_rows(spark, tmp_path):
    """The second part of the previous-row operator reuses the first one's shuffle."""
    table_of(spark, history(5)).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = ordered.with_previous(table, ["node_id"], ["place"], "piece", ["value"])
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString()
    final = final[: final.index("Initial Plan")] if "Initial Plan" in final else final
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_run_over_many_segments(spark):
    values = "xxxxxxxxxxyyyyyyyyxxxxxxxxxxxxzz"
    for width in (1, 2, 3, 7):
        rows = [("n", i, i // width, v) for i, v in enumerate(values)]
        got = ordered.run_position(table_of(spark, rows), ["node_id"], ["place"], "piece", "value")
        want = [1 + len(values[:i]) - len(values[:i].rstrip(v)) for i, v in enumerate(values)]
        assert [r["position"] for r in got.orderBy("place").collect()] == want


def test_islands(spark):
    for width in (1, 23, 10_000):
        rows = [(k, p, p // width, v) for k, p, _, v in history(3)]
        got = ordered.islands(table_of(spark, rows), ["node_id"], ["place"], "piece", "value", "place")
        found = sorted(tuple(r) for r in got.select("node_id", "value", "start", "end", "rows").collect())
        want = []
        for key, mine in by_key(rows).items():
            start = 0
            for i in range(1, len(mine) + 1):
                if i == len(mine) or mine[i][3] != mine[start][3]:
                    want.append((key, mine[start][3], mine[start][1], mine[i - 1][1], i - start))
                    start = i
        assert found == sorted(want)


def test_transitions_do_not_depend_on_segments(spark):
    table = table_of(spark, history(4)).withColumnRenamed("value", "health")
    whole = health_transitions(table, ["place"]).orderBy("node_id").collect()
    pieces = health_transitions(table, ["place"], "piece").orderBy("node_id").collect()
    assert whole == pieces and sum(r["transitions"] for r in whole) > 50


def test_assign_seq(spark):
    boots = ["a", "a", None, "a", "b", " b ", "a", "", "a"]
    rows = [("n", i, i // 2, b) for i, b in enumerate(boots)]
    table = table_of(spark, rows).withColumnRenamed("value", "boot_id")
    got = assign_seq(table, ["place"], "piece").orderBy("place").collect()
    assert [r["assigned_seq"] for r in got] == [1, 2, 1, 3, 1, 2, 1, 1, 2]


def test_sequence_audit(spark):
    steps = [("a", 1), ("a", 2), ("a", 5), ("a", 5), ("a", 4), ("b", 1), ("b", 2)]
    rows = [("n", i, i // 3, boot, seq) for i, (boot, seq) in enumerate(steps)]
    table = spark.createDataFrame(
        rows, "node_id string, place bigint, piece bigint, boot_id string, seq bigint"
    )
    found = sequence_steps(table, ["place"], "piece")
    kinds = [r["step"] for r in found.orderBy("place").collect()]
    assert kinds == ["first", "next", "gap", "duplicate", "regression", "restart", "next"]
    assert tuple(sequence_audit(found).first()) == ("n", 7, 1, 2, 1, 1, 1)


def test_tick_timing(spark):
    rows = [("n", i, i, t, 10, ms) for i, (t, ms) in enumerate(
        [("2026-01-01 00:00:00", 5), ("2026-01-01 00:00:10.0125", 10_001), ("2026-01-01 00:00:19", 10_000)])]
    table = spark.createDataFrame(
        rows, "node_id string, place int, piece int, t string, interval_s int, tick_elapsed_ms bigint"
    ).withColumn("tick_start", F.col("t").cast("timestamp"))
    got = tick_timing(table, ["place"], "piece").orderBy("place").collect()
    assert [r["sleep_drift_ms"] for r in got] == [0, 12, 0]
    assert [r["overrun"] for r in got] == [False, True, False]
    assert [r["sleep_ms"] for r in got] == [9995, 0, 0]


def test_first_of_equally_slow_collectors(spark):
    table = spark.createDataFrame(
        [([("disk", 3), ("cpu", 5), ("memory", 5)],), ([],)], "d array<struct<name:string,ms:int>>"
    )
    got = [tuple(r["t"]) for r in table.select(collector_totals(F.col("d")).alias("t")).collect()]
    assert got == [(13, "cpu", 5), (0, None, None)]


def test_sustained_alerts(spark):
    minutes = [("OK", 0), ("UNHEALTHY", 1), ("UNHEALTHY", 6), ("DEGRADED", 7), ("DEGRADED", 16), ("OK", 30)]
    rows = [("n", i, m // 2, h, f"2026-01-01 00:{m:02d}:00") for i, (h, m) in enumerate(minutes)]
    table = spark.createDataFrame(
        rows, "node_id string, place int, piece int, health string, t string"
    ).withColumn("emitted_ts", F.col("t").cast("timestamp"))
    got = sustained_alerts(table, ["place"], "piece").collect()
    assert [(r["health"], r["reports"], r["seconds"]) for r in got] == [("UNHEALTHY", 2, 300.0)]
