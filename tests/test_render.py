from plain import ROWS_SCHEMA, report, rows

from vigil.operators.fleet import summary_meta
from vigil.operators.filters import summary_filter
from vigil.operators.summarize import summarize_by_node
from vigil.plans import render

GIB = 1024**3


def summaries(spark):
    reports = [
        report("node-a", "UNHEALTHY", 1, reasons=["signal:cpu_critical", "signal:disk_free_low"],
               loadavg_1m=20.0, disk_total_bytes=100 * GIB, disk_free_bytes=6 * GIB,
               mem_total_bytes=32 * GIB, mem_available_bytes=16 * GIB),
        report("node-b", "OK", 0, reasons=["tag"], boot=None),
    ]
    table = spark.createDataFrame(list(rows(reports)), ROWS_SCHEMA)
    table = table.selectExpr("*", "CASE WHEN loadavg_1m IS NOT NULL THEN 8 END AS cpu_count_logical")
    return summarize_by_node(table, 5, ["place"])


def text_of(fragments, fmt):
    ordered = fragments.orderBy("report", "part", "node_id").collect()
    return render.SEPARATORS[fmt].join(r["text"] for r in ordered)


def test_text(spark):
    table = summaries(spark)
    meta = summary_meta(table, summary_filter(), 50, "now", files_seen=3)
    assert text_of(render.document(table, "text", meta), "text") == """\
nodes_seen_tail: 2
nodes_emitted: 2
files_seen: 3

node_id: node-a
current_boot_id: run-3
latest_health: UNHEALTHY
latest_seq: 1
latest_emitted_at: 2031-07-09T04:00:01+00:00
degraded_count_tail: 0 / 1
unhealthy_count_tail: 1 / 1
top_reasons_tail: signal:cpu_critical:1, signal:disk_free_low:1
current_reasons: signal:cpu_critical, signal:disk_free_low
max_cpu1_tail: 20.00
min_mem_available_pct_tail: 50.00%
min_disk_free_pct_tail: 6.00%
health_transitions_tail: 0

node_id: node-b
current_boot_id: unknown
latest_health: OK
latest_seq: 0
latest_emitted_at: 2031-07-09T04:00:00+00:00
degraded_count_tail: 0 / 1
unhealthy_count_tail: 0 / 1
top_reasons_tail: tag:1
current_reasons: none
max_cpu1_tail: n/a
min_mem_available_pct_tail: n/a
min_disk_free_pct_tail: n/a
health_transitions_tail: 0"""


def test_pretty(spark):
    text = text_of(render.document(summaries(spark), "pretty"), "pretty")
    assert text == """\
NODE node-a
-----------
Health: UNHEALTHY
Seq: 1   Boot: run-3
Emitted: 2031-07-09T04:00:01+00:00

CPU load (1m/5m/15m): 20.00 / n/a / n/a
Disk free: 6.0 GB
Memory available: 16 GB

Degraded (tail): 0 / 1
Unhealthy (tail): 1 / 1
Top reasons: signal:cpu_critical:1, signal:disk_free_low:1

NODE node-b
-----------
Health: OK
Seq: unknown   Boot: unknown
Emitted: 2031-07-09T04:00:00+00:00

CPU load (1m/5m/15m): n/a / n/a / n/a
Disk free: n/a
Memory available: n/a

Degraded (tail): 0 / 1
Unhealthy (tail): 0 / 1
Top reasons: tag:1"""


def test_table(spark):
    text = text_of(render.document(summaries(spark), "table"), "table")
    assert text.splitlines() == [
        "NODE    HEALTH     CPU1   MEM_FREE  DISK_FREE  DEG  UNH  TRNS",
        "node-a  UNHEALTHY  20.00  16G       6.0G       0    1    0   ",
        "node-b  OK         n/a    n/a       n/a        0    0    0   ",
    ]
    nobody = summaries(spark).limit(0)
    assert text_of(render.document(nobody, "table"), "table").startswith("NODE  HEALTH  CPU1")


def test_explain(spark):
    text = text_of(render.document(summaries(spark), "explain"), "explain")
    assert text == """\
Node: node-a
Status: UNHEALTHY

Reasons:
- CPU load critical (20.00 > 10.00)
- Disk free low (10% threshold)

Tail Summary:
- Degraded: 0 / 1
- Unhealthy: 1 / 1
- Health transitions: 0
- Max CPU load (1m): 20.00
- Min memory available: 50.00%
- Min disk free: 6.00%
- Most frequent issue: signal:cpu_critical

Node: node-b
Status: OK

Reasons:
- tag

Tail Summary:
- Degraded: 0 / 1
- Unhealthy: 0 / 1
- Health transitions: 0
- Most frequent issue: tag"""
    own = render.explain_block(summaries(spark), {"cpu_unhealthy_factor": 2})
    assert "(20.00 > 16.00)" in own.orderBy("node_id").first()["text"]


def test_trends_are_shown(spark):
    reports = [report("n", "OK", i, f"2026-01-01T0{i}:00:00+00:00", loadavg_1m=2.0 * i) for i in (1, 2)]
    table = summarize_by_node(spark.createDataFrame(list(rows(reports)), ROWS_SCHEMA), 5, ["place"])
    assert "loadavg_1m_trend: rising (+2.00 load/hr)" in render.text_block(table).first()["text"]
    assert render.pretty_block(table).first()["text"].endswith(
        "\n\nTrends:\n  loadavg_1m: rising (+2.00 load/hr)"
    )
    assert render.explain_block(table).first()["text"].endswith(
        "\n\nTrends:\n- loadavg_1m: rising (+2.00 load/hr)"
    )


def test_written_document_is_in_order(spark, tmp_path):
    table = summaries(spark)
    meta = summary_meta(table, summary_filter(), 50, "now")
    render.write_document(render.dual(table, "json", meta), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in parts)
    assert text.index("NODE node-a") < text.index("NODE node-b") < text.index('{"meta":')
    assert text.rstrip().endswith("]}")


def test_unknown_format(spark):
    import pytest

    with pytest.raises(ValueError):
        render.document(summaries(spark), "html")
