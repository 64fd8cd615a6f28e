import json
import os

import pytest
from plain import assert_summaries, line, report, summaries
from pyspark.sql import functions as F

from vigil.operators.filters import filter_summaries, single_node_files
from vigil.operators.summarize import tail_stats
from vigil.plans import commands, render
from vigil.sources import spool

CPU, MEM, DISK = (f"collector_failed:{n}" for n in ("cpu", "memory", "disk"))


def write(path, lines):
    path.write_text("".join(f"{text}\n" for text in lines), encoding="utf-8")
    return str(path)


def joined(fragments, fmt):
    rows = fragments.orderBy("report", "part", "node_id").collect()
    return render.SEPARATORS[fmt].join(r["text"] for r in rows)


@pytest.fixture
def mixed(tmp_path):
    """A kiln and a press write into one spool; one line is cut off."""
    press = [("OK", []), ("DEGRADED", [CPU]), ("OK", []), ("DEGRADED", [CPU, DISK])]
    kiln = [("UNHEALTHY", [MEM]), ("UNHEALTHY", [MEM, DISK])]
    pressed = [line(report("press", h, 40 + i, reasons=r, boot="p9")) for i, (h, r) in enumerate(press)]
    fired = [line(report("kiln", h, 11 + i, reasons=r, boot="k1")) for i, (h, r) in enumerate(kiln)]
    return write(tmp_path / "hall.jsonl", [fired[0], *pressed[:2], pressed[2][:25], fired[1], *pressed[2:]])


def test_summary_of_mixed_spool(spark, mixed):
    triage = commands.summarize_spools(spark, mixed, tail=30, computed_at="today")
    kiln, press = triage.emitted.orderBy("node_id").collect()
    assert (kiln["node_id"], kiln["current_health"], kiln["latest_seq"], kiln["reports_seen_tail"]) == ("kiln", "UNHEALTHY", 12, 2)
    assert (kiln["degraded_count_tail"], kiln["health_transitions_tail"]) == (0, 0)
    assert [tuple(r) for r in kiln["top_reasons_tail"]] == [(MEM, 2), (DISK, 1)]
    assert kiln["current_reasons"] == sorted([DISK, MEM]) and kiln["signal_trends"] == {}
    assert (press["current_health"], press["latest_seq"], press["reports_seen_tail"]) == ("DEGRADED", 43, 4)
    assert (press["degraded_count_tail"], press["health_transitions_tail"]) == (2, 3)
    assert [tuple(r) for r in press["top_reasons_tail"]] == [(CPU, 2), (DISK, 1)]
    meta = triage.meta.first()
    assert (meta["reports_parsed"], meta["reports_invalid"], meta["nodes_seen_tail"]) == (6, 1, 2)
    document = json.loads(joined(triage.render("json"), "json"))
    counts = {"reports_parsed": 6, "reports_invalid": 1, "nodes_seen_tail": 2, "nodes_emitted": 2}
    assert document["meta"] == counts | {"schema_version": "1", "tail_n": 30, "computed_at": "today", "spool_path": mixed}
    assert [(n["node_id"], n["max_cpu1_tail"]) for n in document["nodes"]] == [("kiln", None), ("press", None)]
    assert [(r["reason"], r["count"]) for r in document["nodes"][1]["top_reasons_tail"]] == [(CPU, 2), (DISK, 1)]
    text = joined(triage.render("text"), "text").splitlines()
    assert text[:2] == ["nodes_seen_tail: 2", "nodes_emitted: 2"]
    assert text[3:5] == ["node_id: kiln", "current_boot_id: k1"]


def test_filters_and_alert_codes(spark, mixed):
    def run(**conditions):
        triage = commands.summarize_spools(spark, mixed, 50, **conditions)
        meta = triage.meta.first()
        return triage.alert.first()[0], meta["nodes_seen_tail"], meta["nodes_emitted"]

    assert run(only_degraded=True) == (2, 2, 1)
    assert run(only_unhealthy=True) == (3, 2, 1)
    assert run(node="press") == (0, 2, 1)
    assert run(node="") == (0, 2, 2)
    assert run(min_degraded_count=3) == (0, 2, 0)
    with pytest.raises(ValueError):
        filter_summaries(spark.range(1), only_degraded=True, only_unhealthy=True)


def test_tail_counts_blank_lines(spark, tmp_path):
    path = write(
        tmp_path / "s.jsonl", [line(report("n", seq=i)) for i in range(1, 5)] + ["", "bad", "  "]
    )
    parsed = spool.tail_spool(spark, path, 4)
    assert parsed.count() == 4
    row = tail_stats(spool.reports_of(parsed), spool.ARRIVAL).first()
    assert tuple(row) == (1, "4", "OK")
    assert spool.invalid_counts(parsed).first()["reports_invalid"] == 1
    assert spool.tail_spool(spark, path, 0).count() == 0
    assert spool.tail_spool(spark, path, 99).count() == 7


def test_tail_over_many_blocks_keeps_line_order(spark, tmp_path):
    reports = [report(f"n{i % 3}", ("OK", "DEGRADED")[i % 5 == 0], i, reasons=["r"] * (i % 2))
               for i in range(1, 900)]
    path = write(tmp_path / "long.jsonl", map(line, reports))
    lines = spool.read_lines(spark, path)
    assert lines.select("block_start").distinct().count() > 20
    for n in (1, 7, 250):
        tail = spool.tail_lines(lines, n).orderBy(F.col("tail_rank").desc()).collect()
        assert [r["line"] for r in tail] == [line(r) for r in reports[-n:]]
    table = commands.summarize_spools(spark, path, 250).summaries
    assert_summaries(table, summaries(reports[-250:]))


def test_fleet_folder(spark, tmp_path):
    for name, seqs in (("east", (5, 6, 7)), ("west", (1,))):
        write(tmp_path / f"{name}.jsonl", [line(report(name, seq=i)) for i in seqs] + ["{"] * (name == "west"))
    write(tmp_path / "idle.jsonl", [])
    write(tmp_path / "notes.md", ["# no spool"])
    meta = commands.summarize_folder(spark, str(tmp_path), 20).meta.first()
    assert (meta["files_seen"], meta["nodes_seen_tail"]) == (3, 2)
    assert (meta["reports_parsed"], meta["reports_invalid_total"]) == (4, 1)
    write(tmp_path / "shared.jsonl", [line(report(n)) for n in ("north", "south", "north")])
    with pytest.raises(ValueError, match="multiple node_id"):
        commands.summarize_folder(spark, str(tmp_path), 20)
    for rule, nodes in (("drop", {"east", "west"}), (None, {"east", "west", "north", "south"})):
        kept = commands.summarize_folder(spark, str(tmp_path), 20, one_node_per_file=rule)
        assert {r["node_id"] for r in kept.summaries.collect()} == nodes


def test_missing_paths_of_a_list(spark, tmp_path):
    there = [write(tmp_path / f"{n}.jsonl", [line(report(n))]) for n in ("a", "b")]
    absent = [str(tmp_path / n) for n in ("c.jsonl", "d.jsonl")]
    found = spool.read_spool(spark, [there[0], absent[0], there[1], absent[1]]).collect()
    assert {r["node_id"] for r in found} == {"a", "b"}
    assert spool.read_spool(spark, absent).count() == 0
    with pytest.raises(FileNotFoundError, match="c.jsonl.*d.jsonl"):
        spool.read_lines(spark, [*there, *absent], on_missing="error")


def test_block_group_takes_any_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = spark.createDataFrame([(0,), (1 << 47,)], "block_start long")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1t")
        assert [r[0] for r in lines.select(spool.block_group(lines)).collect()] == [0, 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_node_with_many_files_changes_across_files(spark, tmp_path):
    """Arrival follows the file names; the tail is per file."""
    healths = ["OK", "DEGRADED", "DEGRADED", "OK", "OK", "UNHEALTHY"]
    reports = [report("n", h, i + 1) for i, h in enumerate(healths)]
    for part in range(3):
        write(tmp_path / f"s.{part}.jsonl", map(line, reports[2 * part : 2 * part + 2]))
    table = commands.summarize_folder(spark, str(tmp_path), 2).summaries
    assert_summaries(table, summaries(reports))
    newest_first = [*reports[4:], *reports[:2]]
    write(tmp_path / "s.0.jsonl", map(line, newest_first[:2]))
    write(tmp_path / "s.1.jsonl", map(line, newest_first[2:]))
    (tmp_path / "s.2.jsonl").unlink()
    table = commands.summarize_folder(spark, str(tmp_path), 2).summaries
    assert_summaries(table, summaries(newest_first))


def test_status(spark, tmp_path):
    broken = report("n", "OK", 9)
    broken["identity"] = {}
    path = write(
        tmp_path / "s.jsonl",
        [line(report("n", seq=7)), line(report("n", "DEGRADED", 8, reasons=["b", "a"], boot=None)),
         line(broken), "bad"],
    )
    assert commands.status(spark, path).first()["status"] == (
        "node_id=n health=DEGRADED seq=8 emitted_at=2031-07-09T04:00:08+00:00 reasons=b,a"
    )
    as_json = json.loads(commands.status(spark, path, fmt="json").first()["status"])
    assert as_json == {"node_id": "n", "health": "DEGRADED", "seq": 8, "reasons": ["b", "a"],
                       "emitted_at": "2031-07-09T04:00:08+00:00"}
    assert commands.status(spark, path, tail=2).count() == 0
    with pytest.raises(FileNotFoundError):
        commands.status(spark, str(tmp_path / "none.jsonl"))


def test_missing_and_empty_spools(spark, tmp_path):
    missing = str(tmp_path / "none.jsonl")
    assert tuple(commands.tail_report(spark, missing).first()) == (0, "unknown", "unknown")
    assert tuple(commands.legacy(spark, missing).first()) == ("unknown",) * 5 + (0, "none")
    assert commands.summarize_spools(spark, missing).summaries.count() == 0
    assert commands.summarize_spools(spark, missing).alert.first()[0] == 0
    with pytest.raises(FileNotFoundError):
        commands.validate_spool(spark, missing)


def test_legacy_summary(spark, mixed):
    row = commands.legacy(spark, mixed).first()
    assert tuple(row)[:6] == ("press", "p9", "43", "2031-07-09T04:00:43+00:00", "DEGRADED", 2)
    assert sorted(row[6].split(", ")) == sorted([f"{CPU}:2", f"{DISK}:2", f"{MEM}:2"])


def test_status_of_odd_seq(spark, tmp_path):
    for given, shown in (("abc", "abc"), (3.9, "3.9"), (12, "12")):
        odd = report("n", seq=12)
        odd["timing"]["seq"] = given
        path = write(tmp_path / "odd.jsonl", [line(odd)])
        assert commands.status(spark, path).first()["status"].split()[2] == f"seq={shown}"


def test_invalid_utf8_is_replaced(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_bytes(line(report("né", seq=1)).encode() + b'\n{"identity":{"node_id":"n\xff"}}\n')
    nodes = spool.read_spool(spark, str(path)).orderBy("line_id").collect()
    assert [r["node_id"] for r in nodes] == ["né", "n�"]


def test_append_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "spool")
    for seq in (1, 2):
        table = spark.createDataFrame([(line(report("n", seq=seq)),)], "line string")
        spool.append_reports(table, folder)
    assert os.path.isdir(folder)
    assert sorted(r["seq"] for r in spool.read_spool(spark, folder, "*.txt").collect()) == [1, 2]


def test_single_node_files_ignores_reports_without_node(spark):
    rows = [("f1", "a"), ("f1", None), ("f2", "a"), ("f2", "b")]
    table = spark.createDataFrame(rows, "file_path string, node_id_raw string")
    kept = single_node_files(table, "drop").collect()
    assert {r["file_path"] for r in kept} == {"f1"}
