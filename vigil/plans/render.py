"""Printed reports as tables of text fragments.

A report is never put together in one place. Each renderer turns every summary
into one fragment, and ``document`` adds the fragments around them. Fragments
sorted by ``(part, node_id)`` and joined give the report, so a report over a
large fleet is an ordinary sorted table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigil.functions.health import DEFAULT_THRESHOLDS, Thresholds
from vigil.functions.numbers import fixed
from vigil.functions.text import (
    display_seq,
    format_gb,
    format_gb_compact,
    format_load,
    format_pct,
    reason_label,
)

HEADER, BODY, FOOTER = 0, 1, 2
JSON_FIELDS = [
    "current_boot_id",
    "current_health",
    "current_reasons",
    "degraded_count_tail",
    "health_transitions_tail",
    "latest_emitted_at",
    "latest_seq",
    "max_cpu1_tail",
    "min_disk_free_pct_tail",
    "min_mem_available_pct_tail",
    "node_id",
    "reports_seen_tail",
    "signal_trends",
    "top_reasons_tail",
    "unhealthy_count_tail",
]
TABLE_COLUMNS = ["NODE", "HEALTH", "CPU1", "MEM_FREE", "DISK_FREE", "DEG", "UNH", "TRNS"]


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(*lines: Column) -> Column:
    """Lines joined by newlines; null lines are left out."""
    return F.array_join(F.array(*lines), "\n")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _top_reasons() -> Column:
    pairs = F.transform(
        "top_reasons_tail",
        lambda r: F.concat(r["reason"], F.lit(":"), r["count"].cast("string")),
    )
    listed = F.array_join(pairs, ", ")
    return F.when(listed == "", "none").otherwise(listed)


def _trend_lines(before: str, between: str) -> Column:
    """One line per trend, by signal name; null when there is none."""
    entries = F.array_sort(F.map_entries("signal_trends"))
    lines = F.transform(
        entries,
        lambda e: F.concat(F.lit(before), e["key"], F.lit(between), e["value"]["label"]),
    )
    return F.when(F.size(entries) > 0, F.array_join(lines, "\n"))


def _of_reports(name: str) -> Column:
    return F.concat(_text(name), F.lit(" / "), _text("reports_seen_tail"))


def text_block(summaries: DataFrame) -> DataFrame:
    """``key: value`` lines."""
    shown_reasons = F.when(
        F.col("current_health").isin("DEGRADED", "UNHEALTHY") & (F.size("current_reasons") > 0),
        F.array_join("current_reasons", ", "),
    ).otherwise("none")
    block = _lines(
        F.lit(""),
        _line("node_id: ", F.col("node_id")),
        _line("current_boot_id: ", F.col("current_boot_id")),
        _line("latest_health: ", F.col("current_health")),
        _line("latest_seq: ", display_seq(F.col("latest_seq"))),
        _line("latest_emitted_at: ", F.col("latest_emitted_at")),
        _line("degraded_count_tail: ", _of_reports("degraded_count_tail")),
        _line("unhealthy_count_tail: ", _of_reports("unhealthy_count_tail")),
        _line("top_reasons_tail: ", _top_reasons()),
        _line("current_reasons: ", shown_reasons),
        _line("max_cpu1_tail: ", format_load(F.col("max_cpu1_tail"))),
        _line("min_mem_available_pct_tail: ", format_pct(F.col("min_mem_available_pct_tail"))),
        _line("min_disk_free_pct_tail: ", format_pct(F.col("min_disk_free_pct_tail"))),
        _line("health_transitions_tail: ", _text("health_transitions_tail")),
        _trend_lines("", "_trend: "),
    )
    return summaries.select("node_id", block.alias("text"))


def pretty_block(summaries: DataFrame) -> DataFrame:
    """Readable blocks with an underlined header; seq 0 counts as unknown."""
    header = _line("NODE ", F.col("node_id"))
    seq = F.when(F.col("latest_seq") != 0, _text("latest_seq"))
    trend_lines = _trend_lines("  ", ": ")
    block = _lines(
        header,
        F.repeat(F.lit("-"), F.length(header)),
        _line("Health: ", F.col("current_health")),
        _line("Seq: ", F.coalesce(seq, F.lit("unknown")), "   Boot: ", F.col("current_boot_id")),
        _line("Emitted: ", F.col("latest_emitted_at")),
        F.lit(""),
        _line(
            "CPU load (1m/5m/15m): ",
            format_load(F.col("loadavg_1m")),
            " / ",
            format_load(F.col("loadavg_5m")),
            " / ",
            format_load(F.col("loadavg_15m")),
        ),
        _line("Disk free: ", format_gb(F.col("disk_free_bytes"))),
        _line("Memory available: ", format_gb(F.col("mem_available_bytes"))),
        F.lit(""),
        _line("Degraded (tail): ", _of_reports("degraded_count_tail")),
        _line("Unhealthy (tail): ", _of_reports("unhealthy_count_tail")),
        _line("Top reasons: ", _top_reasons()),
        F.concat(F.lit("\nTrends:\n"), trend_lines),
    )
    return summaries.select("node_id", block.alias("text"))


def _threshold(thresholds: Thresholds | None, key: str) -> Column:
    value = (thresholds or {}).get(key, DEFAULT_THRESHOLDS[key])
    return value if isinstance(value, Column) else F.lit(float(value))


def reason_message(reason: Column, thresholds: Thresholds | None = None) -> Column:
    """A reason's label with the limit it broke, where the signal is still known."""
    label = reason_label(reason)
    load, cores = F.col("loadavg_1m"), F.col("cpu_count_logical")

    def over(key: str) -> Column:
        limit = cores * _threshold(thresholds, key)
        return F.concat(
            label, F.lit(" ("), format_load(load), F.lit(" > "), fixed(limit, 2), F.lit(")")
        )

    def under(key: str) -> Column:
        limit = fixed(_threshold(thresholds, key), 0)
        return F.concat(label, F.lit(" ("), limit, F.lit("% threshold)"))

    has_cpu = (cores != 0) & load.isNotNull()
    has_disk = (F.col("disk_free_bytes") != 0) & (F.col("disk_total_bytes") != 0)
    has_mem = (F.col("mem_available_bytes") != 0) & (F.col("mem_total_bytes") != 0)
    return (
        F.when((reason == "signal:cpu_high") & has_cpu, over("cpu_degraded_factor"))
        .when((reason == "signal:cpu_critical") & has_cpu, over("cpu_unhealthy_factor"))
        .when((reason == "signal:disk_free_low") & has_disk, under("disk_degraded_pct"))
        .when((reason == "signal:disk_free_critical") & has_disk, under("disk_unhealthy_pct"))
        .when((reason == "signal:mem_available_low") & has_mem, under("mem_degraded_pct"))
        .when((reason == "signal:mem_available_critical") & has_mem, under("mem_unhealthy_pct"))
        .otherwise(label)
    )


def explain_block(summaries: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Why each node is in its state; limits shown default to the default thresholds."""
    reasons = F.transform(
        "current_reasons", lambda r: F.concat(F.lit("- "), reason_message(r, thresholds))
    )
    trend_lines = _trend_lines("- ", ": ")
    frequent = F.coalesce(F.get("top_reasons_tail", 0)["reason"], F.lit("none"))
    block = _lines(
        _line("Node: ", F.col("node_id")),
        _line("Status: ", F.col("current_health")),
        F.lit("\nReasons:"),
        F.when(F.size("current_reasons") > 0, F.array_join(reasons, "\n")).otherwise("- none"),
        F.lit("\nTail Summary:"),
        _line("- Degraded: ", _of_reports("degraded_count_tail")),
        _line("- Unhealthy: ", _of_reports("unhealthy_count_tail")),
        _line("- Health transitions: ", _text("health_transitions_tail")),
        _line("- Max CPU load (1m): ", fixed(F.col("max_cpu1_tail"), 2)),
        _line("- Min memory available: ", fixed(F.col("min_mem_available_pct_tail"), 2), "%"),
        _line("- Min disk free: ", fixed(F.col("min_disk_free_pct_tail"), 2), "%"),
        _line("- Most frequent issue: ", frequent),
        F.concat(F.lit("\nTrends:\n"), trend_lines),
    )
    return summaries.select("node_id", block.alias("text"))


def table_cells(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "node_id",
        F.array(
            F.col("node_id"),
            F.col("current_health"),
            format_load(F.col("loadavg_1m")),
            format_gb_compact(F.col("mem_available_bytes")),
            format_gb_compact(F.col("disk_free_bytes")),
            _text("degraded_count_tail"),
            _text("unhealthy_count_tail"),
            _text("health_transitions_tail"),
        ).alias("cells"),
    )


def _table_line(cells: Callable[[int], Column], widths: Column) -> Column:
    padded = [F.rpad(cells(i), widths[f"w{i}"], " ") for i in range(len(TABLE_COLUMNS))]
    return F.concat_ws("  ", *padded)


def table_rows(summaries: DataFrame) -> DataFrame:
    """Aligned table rows; part 0 is the header line.

    Column widths are one row of maxima, used as a scalar subquery.
    """
    cells = table_cells(summaries)
    widths = cells.agg(
        F.struct(
            *[
                F.greatest(
                    F.lit(len(title)), F.coalesce(F.max(F.length(F.col("cells")[i])), F.lit(0))
                ).alias(f"w{i}")
                for i, title in enumerate(TABLE_COLUMNS)
            ]
        ).alias("widths")
    )
    body = cells.withColumn("widths", widths.scalar())
    rows = body.select(
        F.lit(BODY).alias("part"),
        "node_id",
        _table_line(lambda i: F.col("cells")[i], F.col("widths")).alias("text"),
    )
    header = widths.select(
        F.lit(HEADER).alias("part"),
        F.lit("").alias("node_id"),
        _table_line(lambda i: F.lit(TABLE_COLUMNS[i]), F.col("widths")).alias("text"),
    )
    return header.unionByName(rows)


def json_node(summaries: DataFrame) -> DataFrame:
    """One JSON object per node, keys sorted; unknown statistics are null."""
    trend = F.transform_values(
        "signal_trends",
        lambda _, t: F.struct(
            t["direction"].alias("direction"),
            t["label"].alias("label"),
            t["slope_per_hr"].alias("slope_per_hr"),
        ),
    )
    sorted_trends = F.map_from_entries(F.array_sort(F.map_entries(trend)))
    top = F.transform("top_reasons_tail", lambda r: F.struct(r["count"], r["reason"]))
    values = {
        "signal_trends": sorted_trends.alias("signal_trends"),
        "top_reasons_tail": top.alias("top_reasons_tail"),
    }
    node = F.struct(*[values.get(name, F.col(name)) for name in JSON_FIELDS])
    text = F.to_json(node, {"ignoreNullFields": "false"})
    return summaries.select("node_id", text.alias("text"))


def _meta_json(meta: DataFrame) -> Column:
    names = sorted(meta.columns)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


BLOCKS = {"text": text_block, "pretty": pretty_block, "explain": explain_block}

# What stands between the fragments of each format.
SEPARATORS = {"text": "\n", "pretty": "\n\n", "explain": "\n\n", "table": "\n", "json": ""}


def register(name: str, block: Callable[[DataFrame], DataFrame], separator: str = "\n") -> None:
    """Add a renderer of one's own: summaries in, ``node_id`` and ``text`` out."""
    BLOCKS[name] = block
    SEPARATORS[name] = separator


def document(
    summaries: DataFrame, fmt: str, meta: DataFrame | None = None, report: int = 0
) -> DataFrame:
    """A report as fragments ``(report, part, node_id, text)``; sort by the first three.

    ``meta`` is the one-row table of run figures; the text and JSON forms need it.
    """
    if fmt == "table":
        rows = table_rows(summaries)
    elif fmt == "json":
        rows = _json_fragments(summaries, meta)
    elif fmt in BLOCKS:
        rows = BLOCKS[fmt](summaries).select(F.lit(BODY).alias("part"), "node_id", "text")
        if fmt == "text":
            rows = _text_header(meta).unionByName(rows)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return rows.select(F.lit(report).alias("report"), "part", "node_id", "text")


def _edge(part: int, table: DataFrame, text: Column) -> DataFrame:
    return table.select(F.lit(part).alias("part"), F.lit("").alias("node_id"), text.alias("text"))


def _text_header(meta: DataFrame) -> DataFrame:
    names = ["nodes_seen_tail", "nodes_emitted", "files_seen"]
    lines = [_line(f"{n}: ", _text(n)) for n in names if n in meta.columns]
    return _edge(HEADER, meta, _lines(*lines))


def _json_fragments(summaries: DataFrame, meta: DataFrame) -> DataFrame:
    """The JSON document cut before every node.

    All nodes but the first start with a comma; the first node is one minimum.
    """
    nodes = json_node(summaries)
    first = nodes.agg(F.min("node_id")).scalar()
    comma = F.when(F.col("node_id") == first, "").otherwise(",")
    body = nodes.select(
        F.lit(BODY).alias("part"), "node_id", F.concat(comma, F.col("text")).alias("text")
    )
    head = F.concat(F.lit('{"meta":'), _meta_json(meta), F.lit(',"nodes":['))
    return (
        _edge(HEADER, meta, head)
        .unionByName(body)
        .unionByName(_edge(FOOTER, meta, F.lit("]}")))
    )


def dual(summaries: DataFrame, fmt: str, meta: DataFrame) -> DataFrame:
    """The human report followed by the JSON one; ``json`` itself pairs with ``pretty``."""
    human = "pretty" if fmt == "json" else fmt
    return document(summaries, human, meta, 0).unionByName(document(summaries, "json", meta, 1))


def write_document(fragments: DataFrame, path: str) -> None:
    """Write fragments in order as text; part files follow one another."""
    ordered = fragments.orderBy("report", "part", "node_id")
    ordered.select("text").write.mode("overwrite").text(path)
