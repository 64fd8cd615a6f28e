import os
import random
import shutil
from datetime import datetime, timedelta

from plain import ROWS_SCHEMA, assert_summaries, line, report, rows, summaries
from pyspark.sql import functions as F
from test_summary import made_up

from vigil.functions.health import evaluate
from vigil.sources import appends
from vigil.streaming import sources as live, stateful, windows


def replay(spark, tmp_path, table, pieces=4):
    """A stream that gets the rows of ``table`` in several files, one per batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(pieces):
        part = table.filter(F.col("place") % pieces == i) if "mix" in table.columns else table.filter(
            (F.col("place") >= i * 150) & (F.col("place") < (i + 1) * 150)
        )
        part.coalesce(1).write.parquet(str(tmp_path / f"piece{i}"))
        source = next((tmp_path / f"piece{i}").glob("*.parquet"))
        shutil.copy(source, folder / f"{i}.parquet")
    schema = spark.read.parquet(str(folder)).schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    )


def test_node_summaries_over_batches(spark, tmp_path):
    reports = made_up(11)
    table = spark.createDataFrame(list(rows(reports)), ROWS_SCHEMA)
    stream = replay(spark, tmp_path, table)
    process = stateful.node_summaries(str(tmp_path / "state"), str(tmp_path / "out"), 20, ["place"])
    live.run_available(stateful.run_batches(stream, process, str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 4
    newest = stateful.latest(spark, str(tmp_path / "out"), ["node_id"])
    assert newest.count() == newest.select("node_id").distinct().count()
    for batch in (0, 3):
        seen = reports[: (batch + 1) * 150]
        want = []
        for node in {r["identity"]["node_id"] for r in seen}:
            want += [r for r in seen if r["identity"]["node_id"] == node][-20:]
        assert_summaries(out.filter(F.col("batch") == batch), summaries(want))


def test_health_changes_over_batches_and_replays(spark, tmp_path):
    reports = made_up(12)
    table = spark.createDataFrame(list(rows(reports)), ROWS_SCHEMA).withColumn(
        "piece", F.floor(F.col("place") / 40)
    )
    want, last = set(), {}
    for place, r in enumerate(reports):
        node, health = r["identity"]["node_id"], r["assessment"]["health"]
        if last.get(node, health) != health:
            want.add((node, place, last[node], health))
        last[node] = health
    process = stateful.health_changes(str(tmp_path / "state"), str(tmp_path / "out"), ["place"], "piece")
    for batch in range(4):
        part = table.filter((F.col("place") >= batch * 150) & (F.col("place") < (batch + 1) * 150))
        process(part, batch)
        process(part, batch)  # a batch repeated after a failure changes nothing
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {
        (r["node_id"], r["place"], r["prev_health"], r["health"]) for r in got.collect()
    } == want
    assert got.count() == len(want)


def test_live_spool(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    for i in range(3):
        lines = [line(report("n", seq=i * 2 + 1)), "bad", line(report("n", seq=i * 2 + 2))]
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    reports = live.stream_reports(spark, str(folder)).select("node_id", "seq", "health")
    live.run_available(
        live.write_table_stream(reports, str(tmp_path / "out"), str(tmp_path / "cp"))
    )
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [1, 2, 3, 4, 5, 6]
    lines = live.stream_lines(spark, str(folder))
    for _ in range(2):  # a second run finds nothing new
        live.run_available(appends.append_stream(lines, str(tmp_path / "sink"), str(tmp_path / "cp2"), ["file_path", "line"]))
    assert appends.read_lines(spark, str(tmp_path / "sink")).count() == 9


def test_live_verdicts_equal_batch(spark, tmp_path):
    table = spark.createDataFrame(list(rows(made_up(13))), ROWS_SCHEMA).drop("health", "reasons")
    table = table.withColumn("cpu_count_logical", F.lit(8))
    stream = replay(spark, tmp_path, table)
    judged = live.stream_evaluate(stream).select("place", "health", "reasons")
    live.run_available(live.write_table_stream(judged, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("place").collect()
    assert got == evaluate(table).select("place", "health", "reasons").orderBy("place").collect()


def test_late_and_repeated_reports(spark, tmp_path):
    """A repeat is dropped; a row far behind the watermark does not reopen a window."""
    times = [(1, "00:10:00"), (1, "00:10:00"), (2, "03:00:00"), (3, "06:00:00"), (4, "00:20:00"), (5, "09:00:00")]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, (seq, at) in enumerate(times):
        part = spark.createDataFrame([("n", "b", seq, f"2026-01-01 {at}", 5)],
                                     "node_id string, boot_id string, seq bigint, t string, tick_elapsed_ms bigint")
        part = part.select("*", F.col("t").cast("timestamp").alias("emitted_ts"), F.lit(True).alias("overrun"))
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        shutil.copy(next((tmp_path / f"p{i}").glob("*.parquet")), folder / f"{i}.parquet")
    schema = spark.read.parquet(str(folder)).schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    kept = windows.drop_repeats(stream(), "1 hour").select("seq", "emitted_ts")
    live.run_available(live.write_table_stream(kept, str(tmp_path / "o1"), str(tmp_path / "c1")))
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "o1")).orderBy("seq").collect()][:3] == [1, 2, 3]
    counted = windows.tick_windows(stream(), "1 hour", time="emitted_ts")
    live.run_available(live.write_table_stream(counted, str(tmp_path / "o2"), str(tmp_path / "c2")))
    got = spark.read.parquet(str(tmp_path / "o2")).orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["ticks"]) for r in got] == [(0, 2), (3, 1), (6, 1)]


def files_of(folder):
    return {os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns for at, _, names in os.walk(folder) for name in names}


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = stateful.Buckets(str(tmp_path / "state"), ["node_id"], 8)

    def table(values):
        return spark.createDataFrame(list(values.items()), "node_id string, last int")

    nodes = {f"n{i}": i for i in range(40)}
    assert state.before(spark, 0) is None
    state.write(table(nodes), 0)
    one = table({"n3": 100})
    touched = state.touched(one)
    assert len(touched) == 1
    kept = files_of(tmp_path / "state")
    for batch in (1, 2, 3):
        before = state.before(spark, batch, touched)
        others = {r.node_id: r.last for r in before.collect() if r.node_id != "n3"}
        for _ in range(2):  # a batch repeated after a failure
            state.write(table(others | {"n3": 100 * batch}), batch)
    assert {r.node_id: r.last for r in state.before(spark, 4).collect()} == nodes | {"n3": 300}
    now = files_of(tmp_path / "state")
    elsewhere = {f: t for f, t in kept.items() if f"bucket={touched[0]}" not in f and "_SUCCESS" not in f}
    assert elsewhere and all(now[f] == t for f, t in elsewhere.items())
    # versions that no batch can ask for are gone
    assert sorted(os.listdir(tmp_path / "state" / f"bucket={touched[0]}")) == ["batch=2", "batch=3"]


def sessions_of(rows, gap):
    out = []
    for node in sorted({n for n, _, _ in rows}):
        times = sorted((t, h) for n, t, h in rows if n == node and h != "OK")
        for t, h in times:
            if out and out[-1][0] == node and t < out[-1][2]:
                out[-1][2], out[-1][3], out[-1][4] = t + gap, out[-1][3] + 1, out[-1][4] + (h == "UNHEALTHY")
            else:
                out.append([node, t, t + gap, 1, int(h == "UNHEALTHY")])
    return {tuple(x) for x in out}


def test_sessions_grow_and_join_over_batches(spark, tmp_path):
    draw, start = random.Random(5), datetime(2026, 1, 1)
    rows = []
    for i in range(240):
        at = start + timedelta(minutes=30 * i - draw.randint(0, 170))  # out of order, though never late
        rows.append((f"n{draw.randint(0, 3)}", at, draw.choice(["OK", "DEGRADED", "UNHEALTHY"])))
    sessions = stateful.OutageSessions(str(tmp_path / "state"), "2 hours", "3 hours")
    seen = []
    for batch in range(6):
        part = rows[batch * 40 : (batch + 1) * 40]
        seen += part
        table = spark.createDataFrame([(n, t.isoformat(sep=" "), h) for n, t, h in part], "node_id string, t string, health string")
        table = table.withColumn("emitted_ts", F.col("t").cast("timestamp"))
        for _ in range(2):
            sessions.process(table, batch)
        if batch in (0, 3, 5):
            found = sessions.result(spark, batch + 1).selectExpr("node_id", "string(session_start) a", "string(session_end) b", "reports", "unhealthy")
            got = {(r.node_id, datetime.fromisoformat(r.a), datetime.fromisoformat(r.b), r.reports, r.unhealthy) for r in found.collect()}
            assert got == sessions_of(seen, timedelta(hours=2))
    late = spark.createDataFrame([("n0", "UNHEALTHY")], "node_id string, health string").withColumn("emitted_ts", F.lit("2025-12-01").cast("timestamp"))
    count = sessions.result(spark, 6).count()
    sessions.process(late, 6)
    assert sessions.result(spark, 7).count() == count


def test_open_windows_are_shown(spark, tmp_path):
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for batch in range(3):
        part = spark.createDataFrame([("n", batch * 50 + i) for i in range(3)], "node_id string, at int")
        part = part.selectExpr("node_id", "timestamp_seconds(at * 60) AS tick_start", "100L AS tick_elapsed_ms", "true AS overrun")
        part.write.mode("append").parquet(folder)
        rows = windows.tick_windows(spark.readStream.schema(part.schema).parquet(folder), "1 hour")
        live.run_available(stateful.run_batches(rows, stateful.upserts(out), str(tmp_path / "cp"), "update"))
        newest = stateful.latest(spark, out, ["node_id", "window_start"]).selectExpr("hour(window_start) h", "ticks").collect()
        minutes = [k * 50 + i for k in range(batch + 1) for i in range(3)]
        assert {r.h: r.ticks for r in newest} == {h: sum(m // 60 == h for m in minutes) for h in {m // 60 for m in minutes}}
