"""Small plain-Python statements of what the operators must return."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime, timedelta, timezone


def clock(seq) -> str:
    """A made-up start of the machine plus one second per report."""
    return (datetime(2031, 7, 9, 4, tzinfo=timezone.utc) + timedelta(seconds=seq)).isoformat()


def report(node, health="OK", seq=1, at=None, reasons=(), boot="run-3", **signals):
    """A whole report with the signals given and no others."""
    sections = {"meta": dict(schema_version="1", agent_version="7.2-test"), "signals": signals}
    sections["timing"] = dict(seq=seq, emitted_at=clock(seq) if at is None else at)
    sections["identity"] = dict(node_id=node, boot_id=boot)
    sections["assessment"] = dict(reasons=[*reasons], health=health)
    return sections


def line(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def rows(reports):
    """Reports as flat tuples in arrival order, for ``createDataFrame``."""
    for place, r in enumerate(reports):
        s = r["signals"]
        yield (
            place,
            r["identity"]["node_id"],
            r["identity"]["boot_id"],
            r["assessment"]["health"],
            r["assessment"]["reasons"],
            r["timing"]["emitted_at"],
            r["timing"]["seq"],
            s.get("loadavg_1m"),
            s.get("mem_total_bytes"),
            s.get("mem_available_bytes"),
            s.get("disk_total_bytes"),
            s.get("disk_free_bytes"),
        )


ROWS_SCHEMA = (
    "place bigint, node_id string, boot_id string, health string, reasons array<string>,"
    " emitted_at string, seq bigint, loadavg_1m double, mem_total_bytes bigint,"
    " mem_available_bytes bigint, disk_total_bytes bigint, disk_free_bytes bigint"
)


def slope(points):
    """Least-squares slope through (x, y), or None."""
    if len(points) < 2:
        return None
    mx = sum(x for x, _ in points) / len(points)
    my = sum(y for _, y in points) / len(points)
    sxx = sum((x - mx) ** 2 for x, _ in points)
    if sxx == 0:
        return None
    return sum((x - mx) * (y - my) for x, y in points) / sxx


def share(part, whole):
    return part / whole * 100.0 if part is not None and whole else None


def rounded(values, pick):
    known = [v for v in values if v is not None]
    return round(pick(known), 2) if known else None


def summaries(reports, top_k=5):
    """Expected summary figures per node."""
    result = {}
    for node in sorted({r["identity"]["node_id"] for r in reports}):
        mine = [r for r in reports if r["identity"]["node_id"] == node]
        # max keeps the first of equal keys: the first arrival
        newest = max(mine, key=lambda r: (r["timing"]["emitted_at"], r["timing"]["seq"]))
        health = [r["assessment"]["health"] for r in mine]
        tags = Counter(t for r in mine for t in r["assessment"]["reasons"])
        ranked = sorted(tags.items(), key=lambda item: (-item[1], item[0]))
        signals = [r["signals"] for r in mine]
        started = datetime(2026, 1, 1, tzinfo=timezone.utc)

        def trend(name):
            points = [
                ((datetime.fromisoformat(r["timing"]["emitted_at"]) - started).total_seconds(), v)
                for r in mine
                if (v := r["signals"].get(name)) is not None
            ]
            return slope(points)

        result[node] = {
            "latest_seq": newest["timing"]["seq"],
            "latest_emitted_at": newest["timing"]["emitted_at"],
            "current_health": newest["assessment"]["health"],
            "current_boot_id": newest["identity"]["boot_id"],
            "current_reasons": sorted(newest["assessment"]["reasons"]),
            "reports_seen_tail": len(mine),
            "degraded_count_tail": health.count("DEGRADED"),
            "unhealthy_count_tail": health.count("UNHEALTHY"),
            "health_transitions_tail": sum(a != b for a, b in zip(health, health[1:])),
            "top_reasons_tail": ranked[:top_k] if top_k else ranked,
            "max_cpu1_tail": rounded([s.get("loadavg_1m") for s in signals], max),
            "min_mem_available_pct_tail": rounded(
                [share(s.get("mem_available_bytes"), s.get("mem_total_bytes")) for s in signals], min
            ),
            "min_disk_free_pct_tail": rounded(
                [share(s.get("disk_free_bytes"), s.get("disk_total_bytes")) for s in signals], min
            ),
            "slopes": {
                "loadavg_1m": (trend("loadavg_1m"), 3600.0),
                "mem_available_bytes": (trend("mem_available_bytes"), 3600.0 / 1024**3),
                "disk_free_bytes": (trend("disk_free_bytes"), 3600.0 / 1024**3),
            },
        }
    return result


def assert_summaries(table, expected):
    """Compare a summary table with ``summaries``."""
    got = {r["node_id"]: r for r in table.collect()}
    assert sorted(got) == sorted(expected)
    for node, want in expected.items():
        row = got[node]
        for name, value in want.items():
            if name == "slopes":
                for signal, (per_second, factor) in value.items():
                    trend = row["signal_trends"].get(signal)
                    if per_second is None:
                        assert trend is None, (node, signal)
                    else:
                        assert abs(trend["slope_per_hr"] - per_second * factor) < 0.0006
            elif name == "top_reasons_tail":
                assert [(t["reason"], t["count"]) for t in row[name]] == value, node
            else:
                assert row[name] == value, (node, name)
