"""Per-node summaries of report tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.functions.numbers import round_exact
from vigil.functions.parse import parse_timestamp
from vigil.operators import trends
from vigil.operators.ranks import ranked

# Columns of the newest report that a summary shows.
LATEST_SIGNALS = [
    "loadavg_1m",
    "loadavg_5m",
    "loadavg_15m",
    "cpu_count_logical",
    "mem_total_bytes",
    "mem_available_bytes",
    "disk_total_bytes",
    "disk_free_bytes",
]


def _emitted_ts(df: DataFrame) -> Column:
    if "emitted_ts" in df.columns:
        return F.col("emitted_ts").cast("timestamp")
    return parse_timestamp(F.col("emitted_at"))


def _rows(reports: DataFrame, arrival: Sequence[str], segment: str | None) -> DataFrame:
    """One narrow row per report, with its rank back from the last arrival."""
    last_first = ", ".join(f"{c} DESC" for c in arrival)
    within = f"PARTITION BY node_id, _segment ORDER BY {last_first}"
    fixed = {"node_id", "emitted_at", "seq"}
    absent = [c for c in [*LATEST_SIGNALS, "thresholds_hash"] if c not in reports.columns]
    seen = reports.select(
        "node_id",
        (F.lit(0) if segment is None else F.col(segment)).alias("_segment"),
        *[F.col(c) for c in arrival if c not in fixed],
        "emitted_at",
        "seq",
        "boot_id",
        F.expr("coalesce(health, 'unknown') AS health"),
        F.expr("coalesce(reasons, array()) AS reasons"),
        *[F.col(c) for c in [*LATEST_SIGNALS, "thresholds_hash"] if c not in absent],
        *[F.lit(None).cast("string").alias(c) for c in absent],
        trends.micros(_emitted_ts(reports)).alias("_x"),
    )
    # larger rank = earlier arrival; the row before in arrival order is the next one here
    return seen.selectExpr(
        "*",
        f"row_number() OVER ({within}) AS _rank",
        f"lead(health) OVER ({within}) AS _before",
    )


def _partials(rows: DataFrame) -> DataFrame:
    """One aggregation for report statistics and reason counts.

    Each report yields one row for itself and one per reason. Report rows are
    grouped per node and segment, reason rows per node and reason.
    """
    signals = ", ".join(LATEST_SIGNALS)
    wide = rows.selectExpr(
        "*",
        "inline(concat(array(named_struct('is_report', true, 'reason', CAST(NULL AS STRING))),"
        " transform(reasons, r -> named_struct('is_report', false, 'reason', r))))",
    ).selectExpr(
        "node_id",
        "is_report",
        "reason",
        "CASE WHEN is_report THEN _segment END AS _segment",
        "health",
        "_before",
        "_rank",
        "_x",
        "CASE WHEN is_report THEN struct(boot_id, seq, emitted_at, health, reasons,"
        f" {signals}, thresholds_hash) END AS latest",
    )
    newest = "struct(coalesce(latest.emitted_at, ''), coalesce(latest.seq, 0), _rank)"
    mem = "latest.mem_available_bytes / latest.mem_total_bytes * 1e2D"
    disk = "latest.disk_free_bytes / latest.disk_total_bytes * 1e2D"
    return wide.groupBy("node_id", "_segment", "is_report", "reason").agg(
        F.expr("count(*) AS n"),
        F.expr("count_if(health = 'DEGRADED') AS degraded"),
        F.expr("count_if(health = 'UNHEALTHY') AS unhealthy"),
        F.expr("count_if(_before <> health) AS changes"),
        F.expr("max_by(health, _rank) AS first_health"),
        F.expr("min_by(health, _rank) AS last_health"),
        F.expr(f"max_by(latest, {newest}) AS latest"),
        F.expr("max(CAST(latest.loadavg_1m AS DOUBLE)) AS max_load"),
        F.expr(f"min(CASE WHEN latest.mem_total_bytes > 0 THEN {mem} END) AS min_mem"),
        F.expr(f"min(CASE WHEN latest.disk_total_bytes > 0 THEN {disk} END) AS min_disk"),
        *[
            F.expr(f"{trends.moments('_x', f'CAST(latest.{t.signal} AS DOUBLE)')} AS m_{t.signal}")
            for t in trends.TRENDS
        ],
    )


def _stitched(partials: DataFrame, top_k: int | None) -> DataFrame:
    """Order each node's segments, and cut its reasons to the ``top_k`` most frequent."""
    whole = "PARTITION BY node_id, is_report"
    order = f"{whole} ORDER BY _segment, n DESC, reason"
    placed = partials.selectExpr(
        "*",
        f"row_number() OVER ({order}) AS _place",
        f"lag(last_health) OVER ({order}) AS _before",
        *[f"{trends.centre(f'm_{t.signal}', whole)} AS c_{t.signal}" for t in trends.TRENDS],
    )
    if top_k is not None and top_k > 0:
        placed = placed.filter(f"is_report OR _place <= {int(top_k)}")
    return placed


def summarize_by_node(
    reports: DataFrame,
    top_k: int | None = 5,
    arrival: Sequence[str] = ("emitted_at", "event_id"),
    segment: str | None = None,
) -> DataFrame:
    """One summary row per node over the given reports.

    ``arrival`` names the columns that order reports by arrival. ``segment``
    names a column that cuts a node's reports into consecutive pieces (its
    file, or a stretch of time); pass it whenever a node may have more reports
    than one task should sort. Without it each node's reports, say a tail of
    n, are taken as one piece. ``top_k`` of None or below 1 keeps all reasons.
    """
    parts = _stitched(_partials(_rows(reports, arrival, segment)), top_k)
    newest = "struct(coalesce(latest.emitted_at, ''), coalesce(latest.seq, 0), -_place)"
    totals = parts.groupBy("node_id").agg(
        F.expr(f"max_by(latest, {newest}) FILTER (WHERE is_report) AS latest"),
        F.expr("sum(n) FILTER (WHERE is_report) AS reports_seen_tail"),
        F.expr("sum(degraded) FILTER (WHERE is_report) AS degraded_count_tail"),
        F.expr("sum(unhealthy) FILTER (WHERE is_report) AS unhealthy_count_tail"),
        # at most top_k entries, or one per distinct reason
        F.expr(
            "array_sort(collect_list(struct(_place, reason, n AS count))"
            " FILTER (WHERE NOT is_report)) AS top_reasons"
        ),
        F.expr("max(max_load) AS max_load"),
        F.expr("min(min_mem) AS min_mem"),
        F.expr("min(min_disk) AS min_disk"),
        F.expr(
            "sum(changes + CASE WHEN _before <> first_health THEN 1 ELSE 0 END)"
            " FILTER (WHERE is_report) AS changes"
        ),
        # reason rows carry no pairs, so they add nothing to the moments
        *[
            F.expr(
                f"{trends.merged_slope(f'm_{t.signal}', f'c_{t.signal}')} AS s_{t.signal}"
            )
            for t in trends.TRENDS
        ],
    )
    return totals.select(
        "node_id",
        F.expr("coalesce(nullif(latest.boot_id, ''), 'unknown') AS current_boot_id"),
        F.expr("latest.seq AS latest_seq"),
        F.expr("coalesce(nullif(latest.emitted_at, ''), 'unknown') AS latest_emitted_at"),
        F.expr("latest.health AS current_health"),
        F.expr("array_sort(latest.reasons) AS current_reasons"),
        "reports_seen_tail",
        "degraded_count_tail",
        "unhealthy_count_tail",
        F.expr("transform(top_reasons, r -> struct(r.reason, r.count)) AS top_reasons_tail"),
        *[F.expr(f"latest.{c} AS {c}") for c in LATEST_SIGNALS],
        round_exact(F.col("max_load"), 2).alias("max_cpu1_tail"),
        round_exact(F.col("min_mem"), 2).alias("min_mem_available_pct_tail"),
        round_exact(F.col("min_disk"), 2).alias("min_disk_free_pct_tail"),
        F.col("changes").alias("health_transitions_tail"),
        trends.trend_map("s_").alias("signal_trends"),
        F.expr("latest.thresholds_hash AS thresholds_hash"),
    )


def latest_reports(
    reports: DataFrame,
    arrival: Sequence[str] = ("emitted_at", "event_id"),
    keys: Sequence[str] = ("node_id",),
) -> DataFrame:
    """The newest report of each node by emission text and seq; ties go to the first arrival.

    A row number under a limit of 1, so every task sends at most one row per node.
    """
    newest = Window.partitionBy(*keys).orderBy(
        F.coalesce("emitted_at", F.lit("")).desc(),
        F.coalesce("seq", F.lit(0)).desc(),
        *[F.col(c).asc() for c in arrival],
    )
    ranked = reports.withColumn("_newest", F.row_number().over(newest))
    return ranked.filter(F.col("_newest") == 1).drop("_newest")


def reason_counts(reports: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """How often each reason occurs; repeats inside one report count."""
    exploded = reports.select(*keys, F.explode("reasons").alias("reason"))
    return exploded.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("count"))


def top_reasons(
    reports: DataFrame, k: int | None = 5, keys: Sequence[str] = ("node_id",)
) -> DataFrame:
    """The ``k`` most frequent reasons by (-count, reason), with their place."""
    counts = reason_counts(reports, keys)
    order = [F.col("count").desc(), F.col("reason").asc()]
    ranked = counts.withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked if k is None or k <= 0 else ranked.filter(F.col("place") <= k)


def ranked_reasons(reports: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """Every reason by (-count, reason), with its place; no ``keys`` ranks those of all reports together.

    The long form of an unlimited list of reasons: one row each, so neither a task nor a row holds them all.
    """
    counts = reason_counts(reports, keys)
    return ranked(counts, keys, [F.col("count").desc(), F.col("reason").asc()])


def health_transitions(
    reports: DataFrame,
    arrival: Sequence[str] = ("emitted_at", "event_id"),
    segment: str | None = None,
) -> DataFrame:
    """Changes of health between consecutive reports of each node, in arrival order."""
    from vigil.operators.ordered import with_previous

    health = F.coalesce(F.col("health"), F.lit("unknown"))
    needed = list(dict.fromkeys(["node_id", *arrival, *([segment] if segment else [])]))
    rows = reports.select(*needed, health.alias("health"))
    if segment is None:
        order = Window.partitionBy("node_id").orderBy(*arrival)
        rows = rows.withColumn("prev_health", F.lag("health").over(order))
    else:
        rows = with_previous(rows, ["node_id"], arrival, segment, ["health"])
    return rows.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if(F.col("prev_health") != F.col("health")).alias("transitions"),
    )


def last_parsed(reports: DataFrame, arrival: Sequence[str], fields: Sequence[str]) -> Column:
    """Aggregate: chosen fields of the last report in arrival order."""
    return F.max_by(F.struct(*fields), F.struct(*arrival))


def tail_stats(reports: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Number of reports, and seq and health of the last one; ``unknown`` if absent."""
    seq = "seq_text" if "seq_text" in reports.columns else "seq"
    last = last_parsed(reports, arrival, [seq, "health"])
    row = reports.agg(F.count(F.lit(1)).alias("reports_parsed"), last.alias("last"))
    return row.select(
        "reports_parsed",
        F.coalesce(F.col(f"last.{seq}").cast("string"), F.lit("unknown")).alias("last_seq"),
        F.coalesce("last.health", F.lit("unknown")).alias("last_health"),
    )


def legacy_summary(reports: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One summary over all reports together: last report, DEGRADED count, every reason."""
    fields = ["node_id_raw" if "node_id_raw" in reports.columns else "node_id"]
    fields += ["boot_id", "seq", "emitted_at", "health"]
    # report rows and reason rows share one pass; see _partials
    marks = F.concat(
        F.array(F.lit(None).cast("string")), F.coalesce("reasons", F.array().cast("array<string>"))
    )
    rows = reports.select(
        F.struct(*fields).alias("last"),
        F.struct(*arrival).alias("at"),
        F.col("health"),
        F.posexplode(marks).alias("place", "reason"),
    )
    grouped = rows.groupBy("reason").agg(
        F.max_by("last", "at").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("health") == "DEGRADED").alias("degraded"),
    )
    is_report = F.col("reason").isNull()
    entry = F.struct((-F.col("n")).alias("order"), F.col("reason"))
    total = grouped.agg(
        F.max_by("last", F.when(is_report, 1)).alias("last"),
        F.coalesce(F.sum(F.when(is_report, F.col("degraded"))), F.lit(0)).alias("degraded"),
        F.array_sort(F.collect_list(F.when(~is_report, entry))).alias("reasons"),
    )
    listed = F.array_join(
        F.transform(
            "reasons",
            lambda r: F.concat(r["reason"], F.lit(":"), (-r["order"]).cast("string")),
        ),
        ", ",
    )

    def shown(name: str) -> Column:
        return F.coalesce(F.col(f"last.{name}").cast("string"), F.lit("unknown"))

    return total.select(
        shown(fields[0]).alias("node_id"),
        shown("boot_id").alias("boot_id"),
        shown("seq").alias("latest_seq"),
        shown("emitted_at").alias("latest_emitted_at"),
        shown("health").alias("latest_health"),
        F.col("degraded").alias("degraded_count_tail"),
        F.when(listed == "", "none").otherwise(listed).alias("top_reasons_tail"),
    )
