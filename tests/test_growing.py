"""Byte ranges, tails from the ends of files, appends in order and spools that grow."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from test_spool import line, report

from vigil.plans import commands
from vigil.sources import appends, ranges, spool
from vigil.streaming import growing, stateful


def write(path, data):
    with open(path, "wb") as file:
        file.write(data)
    return str(path)


def in_order(lines):
    return [r.line for r in lines.orderBy("file_path", "block_start", "line_id").collect()]


def drawn(seed, most=60):
    draw = random.Random(seed)
    parts = [b"a", b"bc", "é".encode(), b"\xff", b"\n", b"\r\n", b"\r", b" ", b"\n\n"]
    return b"".join(draw.choice(parts) for _ in range(draw.randint(0, most)))


def plain_lines(data):
    return [x.decode("utf-8", "replace") for x in data.splitlines()]


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_ranges_hold_every_line_once(tmp_path, piece, monkeypatch):
    monkeypatch.setattr(ranges, "FIRST", 5)
    for seed in range(150):
        data = drawn(seed)
        with open(write(tmp_path / "f", data), "rb") as source:
            found = []
            for start in range(0, len(data), piece):
                found += ranges.lines_of(source, start, min(len(data), start + piece), len(data))
            assert [t for _, t in found] == plain_lines(data), data
            assert [a for a, _ in found] == sorted({a for a, _ in found})


@pytest.mark.parametrize("n", [1, 3, 50])
def test_tails_equal_plain_ones(spark, tmp_path, n):
    files = {f"{i}.jsonl": drawn(i, 90) for i in range(12)} | {"_hidden.jsonl": b"x\ny", ".h.jsonl": b"z\n", "other.txt": b"no\n"}
    for name, data in files.items():
        write(tmp_path / name, data)
    found = ranges.tail_lines(spark, str(tmp_path), n, "*.jsonl", first=8)
    got = {}
    for r in found.orderBy("file_path", "block_start", "line_id").collect():
        got.setdefault(os.path.basename(r.file_path), []).append(r.line)
    want = {name: plain_lines(data)[-n:] for name, data in files.items() if name.endswith("l")}
    assert got == {k: v for k, v in want.items() if v}


def test_tail_edges(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", b"one\ntwo")
    assert in_order(ranges.tail_lines(spark, path, 1)) == ["two"]
    assert ranges.tail_lines(spark, path, 0).count() == 0
    assert ranges.tail_lines(spark, [path, str(tmp_path / "absent")], 9).count() == 2
    assert ranges.tail_lines(spark, str(tmp_path / "absent"), 9).count() == 0


def test_bytes_read_do_not_depend_on_the_file(spark, tmp_path):
    read = []
    for size in (5_000, 500_000):
        path = write(tmp_path / f"{size}.jsonl", b"0123456789abcde\n" * size)
        files = ranges.list_files(spark, path)
        pieces = ranges.tail_pieces(files, 100, first=256).collect()
        assert sum(p["last"] for p in pieces) == 100
        read.append(sum(p.stop - p.start for p in pieces))
    assert read[0] == read[1] <= 100 * 16 * ranges.FURTHER


def test_folder_summary_by_ranges(spark, tmp_path):
    for name in ("a", "b", "_c"):
        rows = [report(name, "OK" if i % 3 else "DEGRADED", i) for i in range(1, 30)]
        write(tmp_path / f"{name}.jsonl", "".join(line(r) + "\n" for r in rows).encode() + b"broken\n")
    run = commands.summarize_folder(spark, str(tmp_path), tail=10, by_ranges=True)
    assert {r.node_id: r.reports_seen_tail for r in run.emitted.collect()} == {"a": 9, "b": 9, "_c": 9}
    meta = run.meta.first()
    assert (meta.files_seen, meta.reports_parsed, meta.reports_invalid) == (3, 27, 3)


def test_appends_arrive_in_the_order_they_are_made(spark, tmp_path):
    path = str(tmp_path / "spool")
    made = []
    for k, values in enumerate(([5, 1, 9], [4], [], [8, 2, 7, 3])):
        rows = spark.createDataFrame([(v, f"{v}") for v in values], "v long, line string").repartition(3)
        assert appends.append_reports(rows, path, ["v"]) == k
        made += sorted(values)
    found = appends.read_lines(spark, path).orderBy(*spool.ARRIVAL).collect()
    assert [int(r.line) for r in found] == made
    # an append that was not completed does not count, and its number is not used again
    os.makedirs(appends.folder_of(path, 4))
    write(appends.folder_of(path, 4) + "/part-00000.txt", b"half\n")
    assert appends.read_lines(spark, path).count() == len(made)
    assert appends.append_reports(spark.createDataFrame([(0, "x")], "v long, line string"), path, ["v"]) == 5
    assert appends.numbers(str(tmp_path / "none")) == []
    # a repeated micro-batch replaces what it wrote
    again = spark.createDataFrame([(6, "6")], "v long, line string")
    appends.append_reports(again, path, ["v"], number=1)
    appends.append_reports(again, path, ["v"], number=1)
    kept = [r.line for r in appends.read_lines(spark, path).orderBy(*spool.ARRIVAL).collect()]
    assert kept == ["1", "5", "9", "6", "2", "3", "7", "8", "x"]


class Collected:
    """A batch body that keeps what it was given, by the run's number."""

    def __init__(self):
        self.runs = {}

    def __call__(self, batch, run):
        rows = batch.orderBy(*growing.ARRIVAL).collect()
        self.runs[run] = [(r.spool, r.seq) for r in rows]


def reports(name, numbers, ending="\n"):
    return "".join(line(report(name, "OK", k)) + ending for k in numbers).encode()


def test_growing_spools(spark, tmp_path):
    folder, body = tmp_path / "spools", Collected()
    os.makedirs(folder)
    spools = growing.GrowingSpool(spark, str(folder), str(tmp_path / "log"))
    assert spools.advance(body) == 0 and body.runs[0] == []  # nothing there yet
    write(folder / "a.jsonl", reports("a", [1, 2]) + reports("a", [3])[:40])
    write(folder / "b.jsonl", reports("b", [1]))
    write(folder / "empty.jsonl", b"")
    spools.advance(body)
    assert body.runs[1] == [("a", 1), ("a", 2), ("b", 1)]
    write(folder / "a.jsonl", reports("a", [1, 2, 3, 4]))
    spools.advance(body)
    assert body.runs[2] == [("a", 3), ("a", 4)]  # the line that was cut short is read whole
    spools.advance(body)
    assert body.runs[3] == []
    # appended once more, rotated, and begun anew
    write(folder / "a.1.jsonl", reports("a", [1, 2, 3, 4, 5]))
    write(folder / "a.jsonl", reports("a", [6, 7]))
    write(folder / "c.jsonl", reports("c", [1]))
    spools.advance(body)
    assert body.runs[4] == [("a", 5), ("a", 6), ("a", 7), ("c", 1)]
    # written anew and shorter: from its start
    write(folder / "c.jsonl", reports("c", [1, 2, 3]))
    spools.advance(body)
    write(folder / "c.jsonl", reports("c", [1, 9]))
    spools.advance(body)
    assert (body.runs[5], body.runs[6]) == ([("c", 2), ("c", 3)], [("c", 1), ("c", 9)])


def test_a_file_away_for_a_run_is_not_read_again(spark, tmp_path):
    folder, body = tmp_path / "spools", Collected()
    os.makedirs(folder)
    spools = growing.GrowingSpool(spark, str(folder), str(tmp_path / "log"))
    write(folder / "a.jsonl", reports("a", [1, 2]))
    spools.advance(body)
    write(folder / "a.jsonl", b"")
    spools.advance(body)
    write(folder / "a.jsonl", reports("a", [1, 2, 3]))
    spools.advance(body)
    assert body.runs == {0: [("a", 1), ("a", 2)], 1: [], 2: [("a", 3)]}


def test_broken_off_run_is_repeated_with_its_plan(spark, tmp_path):
    folder, body = tmp_path / "spools", Collected()
    os.makedirs(folder)
    write(folder / "a.jsonl", reports("a", [1]))
    log = str(tmp_path / "log")

    def fails(batch, run):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        growing.GrowingSpool(spark, str(folder), log).advance(fails)
    write(folder / "a.jsonl", reports("a", [1, 2]))
    again = growing.GrowingSpool(spark, str(folder), log)
    assert again.advance(body) == 0 and again.advance(body) == 1
    assert body.runs == {0: [("a", 1)], 1: [("a", 2)]}


def test_growing_summaries_equal_one_reading(spark, tmp_path):
    folder = tmp_path / "spools"
    os.makedirs(folder)
    out = str(tmp_path / "out")
    body = stateful.node_summaries(str(tmp_path / "state"), out, 20, growing.ARRIVAL, keys=["spool"])
    spools = growing.GrowingSpool(spark, str(folder), str(tmp_path / "log"))
    healths = random.Random(3).choices(["OK", "DEGRADED", "UNHEALTHY"], k=60)
    whole = "".join(line(report("n", h, k)) + "\n" for k, h in enumerate(healths, 1))
    for cut in (5, 7, 31, 60):
        write(folder / "n.jsonl", "".join(whole.splitlines(True)[:cut]).encode())
        run = spools.advance(body)
    found = spark.read.parquet(f"{out}/batch={run}").first()
    tail = healths[-20:]
    assert found.health_transitions_tail == sum(a != b for a, b in zip(tail, tail[1:], strict=False))
    assert (found.reports_seen_tail, found.degraded_count_tail) == (20, tail.count("DEGRADED"))


def test_named_files_can_be_written_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i % 3}", i, f"line {i}") for i in range(50)], "n string, at long, line string").repartition(4)
    for _ in range(2):
        ranges.write_files(rows, str(tmp_path), F.concat("n", F.lit(".jsonl")), ["at"])
    assert sorted(os.listdir(tmp_path)) == ["n0.jsonl", "n1.jsonl", "n2.jsonl"]
    text = open(tmp_path / "n1.jsonl").read()
    assert [int(re.sub("line ", "", t)) for t in text.splitlines()] == list(range(1, 50, 3))
