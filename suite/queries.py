"""Registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.functions import text as texts
from vigil.functions.health import (
    cpu_reason,
    disk_reason,
    evaluate,
    failure_reasons,
    mem_reason,
)
from vigil.functions.numbers import percent, round_exact
from vigil.functions.parse import has_status_fields, once, parse_timestamp, with_sections
from vigil.functions.reports import assemble, builder_error, report_json
from vigil.operators import (
    alerts,
    filters,
    fleet,
    profiles,
    sequence,
    summarize,
    ticks,
    validate,
)
from vigil.operators.tail import large_tails, tail_rows
from vigil.plans import commands, event_reports as er, render
from vigil.session import fresh_folder, settle
from vigil.sources import appends, event_log, ranges, spool, thresholds
from vigil.streaming import growing, sources as live, stateful, windows

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ARRIVAL = list(er.ARRIVAL)
ORDER = ["event_id"]
TAIL = 200
# the quarters of the events in the order in which they are appended
APPENDED = (2, 0, 3, 1)
COMPUTED_AT = "2026-01-01T00:00:00+00:00"
STRICT = {"cpu_degraded_factor": 0.5, "mem_degraded_pct": 25.0, "disk_unhealthy_pct": 8.0}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def tail_reports(spark: SparkSession, sf: str) -> DataFrame:
    return tail_rows(er.reports(spark, sf), TAIL, ["node_id"], ORDER)


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.summarize_by_node(tail_reports(spark, sf), 5, ORDER)


def flat_summary(table: DataFrame) -> DataFrame:
    """Summary columns with arrays and maps as text, for comparison."""
    top = F.transform(
        "top_reasons_tail", lambda r: F.concat(r["reason"], F.lit(":"), r["count"].cast("string"))
    )
    shown = F.transform(
        F.array_sort(F.map_entries("signal_trends")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]["label"]),
    )
    plain = [
        c
        for c in table.columns
        if c not in ("current_reasons", "top_reasons_tail", "signal_trends", "thresholds_hash")
    ]
    return table.select(
        *plain,
        joined("current_reasons").alias("current_reasons"),
        joined(top).alias("top_reasons_tail"),
        joined(shown).alias("signal_trends"),
    )


# --- signals and verdicts -------------------------------------------------


@query
def reports_view(spark, sf):
    """Assembled reports, flattened again."""
    reports = assemble(er.reports(spark, sf))
    report = F.col("report")
    return reports.select(
        "event_id",
        report["identity"]["node_id"].alias("node_id"),
        report["identity"]["boot_id"].alias("boot_id"),
        report["timing"]["emitted_at"].alias("emitted_at"),
        report["timing"]["seq"].alias("seq"),
        report["assessment"]["health"].alias("health"),
        joined(report["assessment"]["reasons"]).alias("reasons"),
        report["meta"]["schema_version"].alias("schema_version"),
        report["signals"]["loadavg_1m"].alias("loadavg_1m"),
        report["signals"]["mem_available_bytes"].alias("mem_available_bytes"),
        report["signals"]["disk_free_bytes"].alias("disk_free_bytes"),
    )


@query
def pct_signals(spark, sf):
    return er.signals(spark, sf).select(
        "event_id",
        F.round(percent(F.col("mem_available_bytes"), F.col("mem_total_bytes")), 6).alias("mem_pct"),
        F.round(percent(F.col("disk_free_bytes"), F.col("disk_total_bytes")), 6).alias("disk_pct"),
    )


@query
def eval_cpu(spark, sf):
    return er.signals(spark, sf).select("event_id", cpu_reason().alias("reason"))


@query
def eval_mem(spark, sf):
    return er.signals(spark, sf).select("event_id", mem_reason().alias("reason"))


@query
def eval_disk(spark, sf):
    return er.signals(spark, sf).select("event_id", disk_reason().alias("reason"))


@query
def failure_tags(spark, sf):
    """Failure tags; rows without a boot id count as identity failures."""
    boot = F.when(F.col("k") % 13 != 0, F.col("boot_id"))
    return er.signals(spark, sf).select(
        "event_id", joined(F.array_sort(failure_reasons(F.col("outcomes"), boot))).alias("tags")
    )


@query
def health_verdict(spark, sf):
    return er.reports(spark, sf).select("event_id", "health", joined("reasons").alias("reasons"))


@query
def verdict_extra_rule(spark, sf):
    """A rule of one's own next to the built-in ones."""
    rule = ("signal:load_spike", F.col("loadavg_5m") > 4)
    judged = evaluate(er.signals(spark, sf), extra_rules=[rule])
    return judged.select("event_id", "health", joined("reasons").alias("reasons"))


@query
def builder_errors(spark, sf):
    """First broken builder rule per report; seq and versions are damaged on purpose."""
    broken = er.reports(spark, sf).withColumns(
        {
            "seq": F.when(F.col("k") % 10 == 1, 0).otherwise(F.col("seq")),
            "node_id": F.when(F.col("k") % 10 == 2, "").otherwise(F.col("node_id")),
            "health": F.when(F.col("k") % 10 == 3, "BROKEN").otherwise(F.col("health")),
            "emitted_at": F.when(F.col("k") % 10 == 4, "").otherwise(F.col("emitted_at")),
        }
    )
    version = F.when(F.col("k") % 10 == 5, "").otherwise("0.1.0")
    return assemble(broken, agent_version=version).select(
        "event_id", builder_error(F.col("report")).alias("error")
    )


# --- thresholds -----------------------------------------------------------


def threshold_layers_of(spark, sf) -> DataFrame:
    """File and environment layers, one configuration profile per customer."""
    layer = (
        "named_struct('layer', '{0}', 'section', '{1}', 'key', '{2}', 'value', {3}, 'used', {4})"
    )
    rows = [
        ("file", "cpu", "degraded_factor", "CAST((50 + c_custkey % 50) / 100D AS STRING)", "c_custkey % 3 <> 0"),
        ("file", "mem", "degraded_pct", "'15'", "c_custkey % 4 = 0"),
        ("file", "disk", "spare_pct", "'1.5'", "c_custkey % 5 = 0"),
        ("file", "gpu", "degraded_pct", "'3.0'", "c_custkey % 6 = 0"),
        ("env", "mem", "unhealthy_pct", "CAST(c_custkey % 10 AS STRING)", "c_custkey % 7 = 0"),
        ("env", "cpu", "unhealthy_factor", "'oops'", "c_custkey % 11 = 0"),
        ("env", "evaluation", "profile_name", "lower(c_mktsegment)", "c_custkey % 2 = 0"),
        ("file", "disk", "degraded_pct", "'12.5'", "true"),
    ]
    structs = ", ".join(layer.format(*row) for row in rows)
    return (
        er.load(spark, sf, "customer")
        .selectExpr("concat('p', c_custkey) AS profile", f"inline(array({structs}))")
        .filter("used")
        .drop("used")
    )


@query
def threshold_layers(spark, sf):
    return thresholds.resolve_layers(threshold_layers_of(spark, sf))


@query
def threshold_documents(spark, sf):
    """Settings from one JSON document per customer: broken ones, no objects, unknown and odd sections among them."""
    documents = er.load(spark, sf, "customer").selectExpr(
        "concat('p', c_custkey) AS profile",
        """CASE c_custkey % 7
             WHEN 0 THEN '{"cpu": {"degraded_factor": 0.5}'
             WHEN 1 THEN '["cpu"]'
             WHEN 2 THEN concat('{"cpu": 5, "mem": {"degraded_pct": ', c_custkey % 50, '.50}}')
             WHEN 3 THEN concat('{"gpu": {"degraded_pct": 1}, "disk": {"spare_pct": ', c_custkey, ', "degraded_pct": 10}}')
             WHEN 4 THEN concat(' {"evaluation": {"profile_name": "', lower(c_mktsegment), '", "own": {"a": [1, "x"]}}, "mem": [3]}')
             WHEN 5 THEN '{"mem": {"unhealthy_pct": null, "degraded_pct": 15}}'
             ELSE '{"cpu": {"degraded_factor": 0.5}} x' END AS document""",
    )
    return thresholds.resolve_layers(thresholds.document_layers(documents))


@query
def iso_forms(spark, sf):
    """Times of events in basic, week, shortened and offset forms, read back as microseconds."""
    week = "extract(YEAROFWEEK FROM ts), weekofyear(ts), weekday(ts) + 1"
    texts = er.load(spark, sf, "events").selectExpr(
        "event_id",
        f"""CASE event_id % 8
              WHEN 0 THEN date_format(ts, "yyyyMMdd'T'HHmmss")
              WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH")
              WHEN 2 THEN date_format(ts, 'yyyyMMdd')
              WHEN 3 THEN format_string('%04d-W%02d-%d', {week})
              WHEN 4 THEN concat(format_string('%04dW%02d%d', {week}), date_format(ts, "'T'HHmm"))
              WHEN 5 THEN date_format(ts, "yyyy-MM-dd HH:mm:ss,SSSSSS'+0130'")
              WHEN 6 THEN date_format(ts, "yyyyMMdd'x'HH:mm:ss.SSSSSS'-19:30:15'")
              ELSE '2026-W54-1' END AS text""",
    )
    return texts.select("event_id", "text", F.unix_micros(parse_timestamp(F.col("text"))).alias("micros"))


def threshold_profiles(spark, sf) -> DataFrame:
    return thresholds.thresholds_table(thresholds.resolve_layers(threshold_layers_of(spark, sf)))


@query
def thresholds_by_profile(spark, sf):
    return threshold_profiles(spark, sf)


@query
def verdict_by_profile(spark, sf):
    signals = er.signals(spark, sf).withColumn(
        "threshold_profile", F.concat(F.lit("p"), F.col("user_id").cast("string"))
    )
    table = settle(threshold_profiles(spark, sf), "profiles")
    judged = profiles.evaluate_by_profile(signals, table, failure_reasons(F.col("outcomes")))
    return judged.select("event_id", "health", joined("reasons").alias("reasons"))


@query
def verdict_shift_matrix(spark, sf):
    changes = profiles.verdict_changes(
        er.reports(spark, sf), STRICT, failure_reasons(F.col("outcomes"))
    )
    return profiles.verdict_matrix(changes)


# --- tails and summaries --------------------------------------------------


@query
def tail_per_node(spark, sf):
    return tail_reports(spark, sf).select("node_id", "event_id", F.col("tail_rank").cast("bigint"))


@query
def tail_large(spark, sf):
    """The last 12,000 order lines of either status, found by counting along the order keys."""
    lines = er.load(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_quantity")
    return large_tails(lines, 12_000, ["l_linestatus"], ["l_orderkey", "l_linenumber"])


@query
def node_summary(spark, sf):
    return flat_summary(summaries(spark, sf))


@query
def node_history_summary(spark, sf):
    """Summaries over whole histories, in hourly segments."""
    table = summarize.summarize_by_node(er.reports(spark, sf), 5, ORDER, segment=er.SEGMENT)
    return flat_summary(table)


@query
def node_counts(spark, sf):
    return summaries(spark, sf).select(
        "node_id", "reports_seen_tail", "degraded_count_tail", "unhealthy_count_tail"
    )


@query
def node_latest(spark, sf):
    """Newest report per node; times cut to the day, so that seq decides."""
    rows = er.reports(spark, sf).withColumns(
        {"emitted_at": F.substring("emitted_at", 1, 10), "seq": F.col("k").cast("bigint")}
    )
    return summarize.latest_reports(rows, ORDER).select(
        "node_id", "event_id", "boot_id", "seq", "emitted_at", "health", joined("reasons").alias("reasons")
    )


@query
def node_extremes(spark, sf):
    return summaries(spark, sf).select(
        "node_id", "max_cpu1_tail", "min_mem_available_pct_tail", "min_disk_free_pct_tail"
    )


@query
def reason_counts(spark, sf):
    return summarize.reason_counts(er.reports(spark, sf))


@query
def top_reasons(spark, sf):
    return summarize.top_reasons(er.reports(spark, sf), 3).select(
        "node_id", "reason", "count", F.col("place").cast("bigint").alias("place")
    )


@query
def ranked_reasons(spark, sf):
    return summarize.ranked_reasons(er.reports(spark, sf))


@query
def fleet_reasons(spark, sf):
    return summarize.ranked_reasons(er.reports(spark, sf), keys=())


@query
def health_transitions(spark, sf):
    return summarize.health_transitions(er.reports(spark, sf), ORDER, er.SEGMENT)


@query
def signal_trends(spark, sf):
    return (
        summaries(spark, sf)
        .select("node_id", F.explode("signal_trends").alias("signal", "trend"))
        .select("node_id", "signal", "trend.direction", "trend.slope_per_hr", "trend.label")
    )


@query
def filter_node(spark, sf):
    return filters.filter_summaries(summaries(spark, sf), node="node-07").select(
        "node_id", "current_health", "reports_seen_tail"
    )


@query
def filter_degraded(spark, sf):
    return filters.filter_summaries(summaries(spark, sf), only_degraded=True).select(
        "node_id", "current_health", "degraded_count_tail"
    )


@query
def filter_unhealthy(spark, sf):
    return filters.filter_summaries(summaries(spark, sf), only_unhealthy=True).select(
        "node_id", "current_health", "unhealthy_count_tail"
    )


@query
def filter_min_degraded(spark, sf):
    return filters.filter_summaries(summaries(spark, sf), min_degraded_count=45).select(
        "node_id", "current_health", "degraded_count_tail"
    )


@query
def fleet_rollup(spark, sf):
    return fleet.fleet_rollup(summaries(spark, sf))


@query
def alert_code(spark, sf):
    keep = filters.summary_filter(only_degraded=True)
    return fleet.alert_code(summaries(spark, sf).filter(keep))


@query
def summary_meta(spark, sf):
    return meta_of(summaries(spark, sf))


@query
def legacy_summary(spark, sf):
    return summarize.legacy_summary(er.reports(spark, sf), ORDER)


@query
def tail_stats(spark, sf):
    return summarize.tail_stats(tail_reports(spark, sf), ORDER)


@query
def mixed_thresholds(spark, sf):
    rows = er.reports(spark, sf).withColumn(
        "thresholds_hash", F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"))
    )
    return fleet.mixed_thresholds(summarize.latest_reports(rows, ORDER))


# --- lines, parsing and validation ---------------------------------------


def report_lines(spark, sf) -> DataFrame:
    """One JSON line per report; some are damaged by the rule in ``fault``."""
    # the events may lie in one split, and a line is many times their size
    events = ranges.tasks(er.load(spark, sf, "events"), "event_id")
    lines = once(
        assemble(er.reports_of(events)).withColumn("fault", F.col("event_id") % 40),
        json=report_json(F.col("report")),
        short=report_json(F.struct("report.assessment", "report.identity", "report.timing")),
    )
    damaged = """
        CASE fault
            WHEN 1 THEN ' '
            WHEN 2 THEN left(json, length(json) - 3)
            WHEN 3 THEN '[1,2]'
            WHEN 4 THEN short
            WHEN 5 THEN regexp_replace(json, '"seq":([0-9]+)', '"seq":"$1"')
            WHEN 6 THEN regexp_replace(json, '"health":"[A-Z]+"', '"health":"BROKEN"')
            WHEN 7 THEN regexp_replace(json, '"seq":[0-9]+', '"seq":0')
            WHEN 8 THEN regexp_replace(json, '"node_id":"[^"]*"', '"node_id":""')
            WHEN 9 THEN regexp_replace(json, '"emitted_at":"[^"]*"', '"emitted_at":"yesterday"')
            WHEN 10 THEN replace(json, '"schema_version":"1"', '"schema_version":2')
            WHEN 11 THEN regexp_replace(json, '"reasons":\\\\[[^]]*\\\\]', '"reasons":"none"')
            WHEN 12 THEN regexp_replace(json, '"signals":\\\\{[^}]*\\\\}', '"signals":[]')
            WHEN 13 THEN regexp_replace(replace(json, '"schema_version":"1"', '"schema_version":"2"'),
                                        '"health":"[A-Z]+"', '"health":null')
            WHEN 14 THEN concat(json, ' x')
            WHEN 15 THEN concat('  ', json, ' ')
            WHEN 16 THEN regexp_replace(json, '"seq":[0-9]+', '"seq":3.9')
            WHEN 17 THEN regexp_replace(json, '"disk_free_bytes":([0-9]+)', '"disk_free_bytes":"$1"')
            ELSE json
        END"""
    return once(lines, line=F.expr(damaged)).selectExpr(
        "event_id",
        "fault",
        "node_id AS file_path",
        f"{er.SEGMENT} AS block_start",
        "event_id AS line_id",
        "line",
    )


@query
def report_json_lines(spark, sf):
    return assemble(er.reports(spark, sf)).select("event_id", report_json(F.col("report")).alias("line"))


@query
def parse_lines(spark, sf):
    parsed = spool.parse_lines(report_lines(spark, sf))
    reports = spool.reports_of(parsed)
    return reports.select(
        "event_id",
        "node_id",
        "health",
        joined("reasons").alias("reasons"),
        "emitted_at",
        stamp(parse_timestamp(F.col("emitted_at"))).alias("emitted_ts"),
        "seq",
        "schema_version",
        "heartbeat_ok",
        "loadavg_1m",
        "loadavg_5m",
        "loadavg_15m",
        "mem_available_bytes",
        "disk_free_bytes",
    )


@query
def invalid_counts(spark, sf):
    return spool.invalid_counts(spool.parse_lines(report_lines(spark, sf)))


@query
def last_valid_report(spark, sf):
    """Last complete report of each spool, as a status line."""
    parsed = spool.parse_lines(report_lines(spark, sf))
    last = commands.last_valid_reports(parsed)
    return commands.status_lines(last).select("file_path", "status")


@query
def status_json(spark, sf):
    parsed = spool.parse_lines(report_lines(spark, sf))
    last = commands.last_valid_reports(parsed)
    return commands.status_lines(last, "json").select("file_path", "status")


@query
def valid_report_fields(spark, sf):
    parsed = spool.parse_lines(report_lines(spark, sf))
    return with_sections(parsed).select(
        "event_id", F.coalesce(has_status_fields(), F.lit(False)).alias("complete")
    )


@query
def validate_reports(spark, sf):
    checked = validate.validate_lines(report_lines(spark, sf))
    return checked.select("event_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query
def validation_errors(spark, sf):
    """Violations in the last 100 non-blank lines of each spool."""
    checked = validate.validate_tail(report_lines(spark, sf), 100)
    return validate.validation_errors(checked).select(
        F.col("file_path").alias("spool"), "line_no", "message"
    )


@query
def validation_all_lines(spark, sf):
    """Line numbers over whole spools (no tail)."""
    checked = validate.validate_tail(report_lines(spark, sf), 0)
    return checked.select(F.col("file_path").alias("spool"), "line_no", "is_valid", "event_id")


@query
def validation_counts(spark, sf):
    return validate.validation_counts(validate.validate_tail(report_lines(spark, sf), 100))


@query
def quarantine(spark, sf):
    good, bad = validate.quarantine(validate.validate_lines(report_lines(spark, sf)))
    return (
        good.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines")).withColumn("lot", F.lit("valid"))
        .unionByName(
            bad.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines")).withColumn("lot", F.lit("invalid"))
        )
    )


def reports_in_files(spark, sf) -> DataFrame:
    file = F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 30).otherwise(
        100 + F.col("user_id") % 40
    )
    return er.reports(spark, sf).withColumn("file_path", F.concat(F.lit("f"), file.cast("string")))


@query
def multi_node_files(spark, sf):
    return filters.multi_node_files(reports_in_files(spark, sf))


@query
def single_node_files(spark, sf):
    kept = filters.single_node_files(reports_in_files(spark, sf), "drop")
    return kept.groupBy("file_path", "node_id").agg(F.count(F.lit(1)).alias("reports"))


# --- event log ------------------------------------------------------------


def event_lines(spark, sf) -> DataFrame:
    """The agent's event log, derived from the events; one event line per row."""
    table = er.load(spark, sf, "events").selectExpr(
        "event_id",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
        "event_type AS source",
        "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS at",
        "CAST(floor(value * 100) AS BIGINT) AS ms",
    )
    line = """to_json(named_struct(
            'event_type', CASE WHEN k = 99 THEN 'agent_nap' ELSE element_at(map(
                'click', 'agent_tick', 'view', 'agent_tick_metrics', 'error', 'collector_failed',
                'signup', 'health_report_emitted', 'purchase', 'spool_rotated'), source) END,
            'agent_version', CASE WHEN k <> 98 THEN '0.1.0' END,
            'utc_now', CASE WHEN k = 97 THEN 'now' ELSE concat(at, 'Z') END,
            'mode', CASE WHEN k = 96 THEN 'daemon' WHEN k % 2 = 0 THEN 'run' ELSE 'oneshot' END,
            'collector', CASE WHEN source = 'error' THEN element_at(
                array('identity', 'heartbeat', 'cpu', 'memory', 'disk', 'network'), k % 6 + 1) END,
            'error_type', CASE WHEN source = 'error' THEN element_at(
                array('OSError', 'ValueError', 'TimeoutError'), k % 3 + 1) END,
            'message', CASE WHEN source = 'error' THEN repeat('no data ', k + 1) END,
            'tick_elapsed_ms', CASE WHEN source = 'click' THEN ms - 1000 * CAST(k = 95 AS BIGINT) * 100 END,
            'seq', CASE WHEN source = 'signup' THEN CASE WHEN k = 94 THEN 0 ELSE event_id + 1 END END,
            'overrun', CASE WHEN source = 'view' THEN ms > 3600 END)) """
    return once(table, line=F.expr(line)).select("event_id", "line")


@query
def validate_events(spark, sf):
    checked = validate.validate_events(event_lines(spark, sf))
    return checked.select("event_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query
def collector_failures(spark, sf):
    return ticks.collector_failures(event_log.parse_events(event_lines(spark, sf)))


@query
def event_messages(spark, sf):
    """Known events only, with their messages cut to 200 characters."""
    events = event_log.parse_events(event_lines(spark, sf))
    return events.select(
        "event_id", "event_type", texts.truncate_message(F.col("message")).alias("message")
    )


# --- order over whole histories ------------------------------------------


@query
def assign_seq(spark, sf):
    """Sequence numbers per boot run; every 13th reading has no boot id."""
    rows = er.signals(spark, sf).select(
        "event_id",
        "node_id",
        F.when(F.col("k") % 13 != 0, F.col("boot_id")).alias("boot_id"),
        er.SEGMENT,
    )
    return sequence.assign_seq(rows, ORDER, er.SEGMENT).select(
        "event_id", "node_id", "assigned_seq"
    )


def clocked(spark, sf) -> DataFrame:
    """Reports numbered by a slow clock that sometimes jumps back."""
    started = "(dayofmonth(emitted_ts) - 1) div 10 * 10 * 24"
    hour = "(dayofmonth(emitted_ts) - 1) * 24 + hour(emitted_ts)"
    back = "CASE WHEN k % 25 = 0 THEN 3 ELSE 0 END"
    return er.signals(spark, sf).selectExpr(
        "event_id",
        "node_id",
        "boot_id",
        er.SEGMENT,
        f"CAST(greatest(1, {hour} - {started} + 1 - {back}) AS BIGINT) AS seq",
    )


@query
def sequence_steps(spark, sf):
    steps = sequence.sequence_steps(clocked(spark, sf), ORDER, er.SEGMENT)
    return steps.select("event_id", "node_id", "step", F.col("missed").cast("bigint"))


@query
def sequence_audit(spark, sf):
    return sequence.sequence_audit(sequence.sequence_steps(clocked(spark, sf), ORDER, er.SEGMENT))


def ticks_view(table: DataFrame) -> DataFrame:
    return er.signals_of(table).selectExpr(
        "event_id",
        "node_id",
        "emitted_ts AS tick_start",
        er.SEGMENT,
        "3600 AS interval_s",
        "CAST(floor(value * 100000) AS BIGINT) AS tick_elapsed_ms",
        "k",
    )


def tick_table(spark, sf) -> DataFrame:
    rows = ticks_view(er.load(spark, sf, "events"))
    return ticks.tick_timing(rows, ORDER, er.SEGMENT)


@query
def tick_drift(spark, sf):
    return tick_table(spark, sf).select(
        "event_id", "node_id", "sleep_drift_ms", "overrun", "sleep_ms"
    )


@query
def tick_rollup(spark, sf):
    table = ticks.tick_rollup(tick_table(spark, sf), "1 day")
    return table.select(
        "node_id",
        stamp("window_start").alias("window_start"),
        stamp("window_end").alias("window_end"),
        "ticks",
        "overruns",
        F.round("overrun_rate", 6).alias("overrun_rate"),
        F.round("mean_tick_ms", 3).alias("mean_tick_ms"),
        "p50_tick_ms",
        "p95_tick_ms",
        "max_tick_ms",
        "max_drift_ms",
    )


@query
def slowest_collector(spark, sf):
    durations = F.expr(
        """array(
            named_struct('name', 'identity', 'ms', k % 7),
            named_struct('name', 'heartbeat', 'ms', k % 5),
            named_struct('name', 'cpu', 'ms', k % 3),
            named_struct('name', 'memory', 'ms', k % 11),
            named_struct('name', 'disk', 'ms', k % 2),
            named_struct('name', 'network', 'ms', k % 13))"""
    )
    totals = ticks.collector_totals(durations)
    return er.signals(spark, sf).select("event_id", totals.alias("t")).select("event_id", "t.*")


@query
def sustained_alerts(spark, sf):
    table = alerts.sustained_alerts(er.reports(spark, sf), ORDER, er.SEGMENT)
    return table.select(
        "node_id",
        "health",
        stamp("start").alias("started"),
        stamp("end").alias("ended"),
        "reports",
        F.round("seconds", 3).alias("seconds"),
    )


# --- printed reports ------------------------------------------------------


def written_summaries(spark, sf) -> DataFrame:
    """Summaries that a document reads more than once."""
    return settle(summaries(spark, sf), "summaries")


def meta_of(table: DataFrame) -> DataFrame:
    keep = filters.summary_filter(min_degraded_count=45)
    return fleet.summary_meta(table, keep, TAIL, COMPUTED_AT)


@query
def render_text(spark, sf):
    table = written_summaries(spark, sf)
    return render.document(table, "text", meta_of(table))


@query
def render_pretty(spark, sf):
    return render.document(summaries(spark, sf), "pretty")


@query
def render_table(spark, sf):
    return render.document(written_summaries(spark, sf), "table")


@query
def render_explain(spark, sf):
    return render.document(summaries(spark, sf), "explain")


@query
def summary_json(spark, sf):
    table = written_summaries(spark, sf)
    return render.document(table, "json", meta_of(table))


@query
def dual_output(spark, sf):
    table = written_summaries(spark, sf)
    return render.dual(table, "json", meta_of(table))


@query
def render_own(spark, sf):
    """A renderer of one's own, registered by name."""
    render.register(
        "brief",
        lambda s: s.select("node_id", F.concat_ws(" ", "node_id", "current_health").alias("text")),
    )
    return render.document(summaries(spark, sf), "brief")


# --- spools on disk -------------------------------------------------------


def written_spool(spark, sf) -> str:
    """Write all report lines as spool files, ordered by node and event."""
    folder = fresh_folder(spark, "spool")
    ordered = report_lines(spark, sf).repartitionByRange("file_path", "line_id")
    spool.append_reports(ordered.sortWithinPartitions("file_path", "line_id"), folder)
    return folder


@query
def spool_read(spark, sf):
    """Spool written and read back: every line that parses is a report."""
    reports = spool.read_spool(spark, written_spool(spark, sf), "*.txt")
    return reports.groupBy("node_id", "health").agg(
        F.count(F.lit(1)).alias("reports"), F.sum("mem_available_bytes").alias("memory")
    )


@query
def spool_summary(spark, sf):
    """Per-node summary over spool files, in file order."""
    reports = spool.read_spool(spark, written_spool(spark, sf), "*.txt")
    table = summarize.summarize_by_node(reports, 5, spool.ARRIVAL, segment="file_path")
    return table.select(*SPOOL_FIGURES)


def named_spools(spark, lines: DataFrame, folder: str) -> str:
    """Write lines as one spool file per node, in event order."""
    ranges.write_files(lines, folder, F.concat("file_path", F.lit(".jsonl")), ["line_id"])
    return folder


SPOOL_FIGURES = (
    "node_id",
    "reports_seen_tail",
    "degraded_count_tail",
    "unhealthy_count_tail",
    "health_transitions_tail",
    "latest_emitted_at",
    "max_cpu1_tail",
    "min_mem_available_pct_tail",
    "min_disk_free_pct_tail",
)


@query
def spool_tail_summary(spark, sf):
    """The folder summary command over tails found from the ends of the files, with its run figures."""
    folder = named_spools(spark, report_lines(spark, sf), fresh_folder(spark, "fleet"))
    triage = commands.summarize_spools(spark, folder, 50, glob="*.jsonl", computed_at=COMPUTED_AT, by_ranges=True)
    meta = triage.meta.select(
        "tail_n", "files_seen", "nodes_seen_tail", "nodes_emitted", "reports_parsed", "reports_invalid", "reports_invalid_total"
    ).first()
    return triage.emitted.select(*SPOOL_FIGURES, *(F.lit(value).alias(name) for name, value in meta.asDict().items()))


@query
def tail_ranges(spark, sf):
    """The last 100 physical lines of every spool, read by byte ranges from the ends of the files."""
    folder = named_spools(spark, report_lines(spark, sf), fresh_folder(spark, "ranges"))
    lines = ranges.tail_lines(spark, folder, 100, "*.jsonl", first=4096)
    name = F.regexp_extract("file_path", r"([^/]*)\.jsonl$", 1).alias("spool")
    return lines.select(name, F.md5("line").alias("line_md5"))


@query
def spool_appends(spark, sf):
    """Four appends to one spool, in another order than the events'; what depends on arrival follows the appends."""
    folder = fresh_folder(spark, "appends")
    # an append reads its rows twice, and two results are taken from the reports
    lines = settle(report_lines(spark, sf).select("event_id", "line"), "append-lines")
    for quarter in APPENDED:
        appends.append_reports(lines.where(F.col("event_id") % 4 == quarter), folder, ORDER)
    reports = settle(appends.read_spool(spark, folder), "append-reports")
    table = summarize.summarize_by_node(reports, 5, spool.ARRIVAL, segment="file_path")
    last = reports.groupBy("node_id").agg(F.max_by(F.struct("seq", "health"), F.struct(*spool.ARRIVAL)).alias("last"))
    return table.join(last, "node_id").select(
        *SPOOL_FIGURES, F.col("last.seq").alias("last_seq"), F.coalesce("last.health", F.lit("unknown")).alias("last_health")
    )


# --- live versions --------------------------------------------------------


def live_events(spark, sf) -> DataFrame:
    er.load(spark, sf, "events")
    return live.stream_table(spark, sf, "events.parquet")


def live_result(spark, rows: DataFrame, label: str) -> DataFrame:
    out, checkpoint = fresh_folder(spark, label), fresh_folder(spark, f"{label}-checkpoint")
    live.run_available(live.write_table_stream(rows, out, checkpoint))
    return spark.read.schema(rows.schema).parquet(out)


def live_batches(spark, sf, rows_of, process, label: str, mode: str = "append") -> int:
    """Let the events arrive in four parts, each a micro-batch of its own; returns the number of batches.

    ``rows_of`` makes the stream to process from the stream of events.
    """
    events = er.load(spark, sf, "events")
    folder, checkpoint = fresh_folder(spark, f"{label}-in"), fresh_folder(spark, f"{label}-checkpoint")
    parts = events.agg(F.max("event_id")).first()[0] // 4 + 1
    for part in range(4):
        events.where(F.floor(F.col("event_id") / parts) == part).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(events.schema).parquet(folder)
        live.run_available(stateful.run_batches(rows_of(arriving), process, checkpoint, mode))
    return 4


@query
def stream_evaluate(spark, sf):
    """Live verdicts, appended to a table."""
    rows = er.reports_of(live_events(spark, sf))
    result = live_result(spark, rows.select("event_id", "health", "reasons"), "evaluate")
    return result.select("event_id", "health", joined("reasons").alias("reasons"))


@query
def stream_sink(spark, sf):
    """Live reports appended to a spool folder as JSON lines, then read back."""
    reports = assemble(er.reports_of(live_events(spark, sf)))
    lines = reports.select("event_id", report_json(F.col("report")).alias("line"))
    out, checkpoint = fresh_folder(spark, "sink"), fresh_folder(spark, "sink-checkpoint")
    live.run_available(appends.append_stream(lines, out, checkpoint, ORDER))
    return appends.read_spool(spark, out).select((F.col("seq") - 1).alias("event_id"), "node_id", "health")


@query
def stream_reports(spark, sf):
    """Spool folder read as a stream of parsed reports."""
    reports = live.stream_reports(spark, written_spool(spark, sf), "*.txt")
    result = live_result(spark, reports.select("node_id", "health", "seq"), "reports")
    return result.groupBy("node_id", "health").agg(
        F.count(F.lit(1)).alias("reports"), F.sum("seq").alias("seq_sum")
    )


@query
def stream_growing_spool(spark, sf):
    """Spools that grow and are rotated between three runs; each run reads what is new and updates the summaries."""
    folder, log = fresh_folder(spark, "growing"), fresh_folder(spark, "growing-log")
    state, out = fresh_folder(spark, "growing-state"), fresh_folder(spark, "growing-summary")
    last_event = F.col("event_id") / er.load(spark, sf, "events").agg(F.max("event_id")).scalar()
    lines = settle(report_lines(spark, sf).withColumn("part", last_event), "growing-lines")
    spools = growing.GrowingSpool(spark, folder, log)
    body = stateful.node_summaries(state, out, TAIL, growing.ARRIVAL, keys=["spool"])
    # half of the lines, the last one of a spool cut short; then some whole lines more
    half = lines.where("part <= 0.5")
    newest = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("line_id"))) == 1
    cut_short = half.withColumn("line", F.when(newest, F.expr("left(line, 9)")).otherwise(F.col("line")))
    ranges.write_files(cut_short, folder, F.concat("file_path", F.lit(".jsonl")), ["line_id"], ending_of_last=False)
    spools.advance(body)
    named_spools(spark, lines.where("part <= 0.8"), folder)
    spools.advance(body)
    # some more, then a rotation of half of the spools, then the rest
    old = lines.where("part <= 0.9 AND right(file_path, 1) % 2 = 0")
    ranges.write_files(old, folder, F.concat("file_path", F.lit(".1.jsonl")), ["line_id"])
    named_spools(spark, lines.where("part > 0.9 OR right(file_path, 1) % 2 = 1"), folder)
    run = spools.advance(body)
    return spark.read.parquet(f"{out}/batch={run}").select(*SPOOL_FIGURES)


@query
def stream_node_summary(spark, sf):
    state, out = fresh_folder(spark, "summary-state"), fresh_folder(spark, "summary")
    process = stateful.node_summaries(state, out, TAIL, ORDER)
    live_batches(spark, sf, lambda events: er.reports_of(events).drop("outcomes"), process, "summary")
    return flat_summary(stateful.latest(spark, out, ["node_id"]))


@query
def stream_transitions(spark, sf):
    def rows_of(events):
        return er.reports_of(events).select("node_id", "event_id", "health", er.SEGMENT)

    state, out = fresh_folder(spark, "changes-state"), fresh_folder(spark, "changes")
    process = stateful.health_changes(state, out, ORDER, er.SEGMENT)
    live_batches(spark, sf, rows_of, process, "changes")
    return spark.read.parquet(out).select("node_id", "event_id", "prev_health", "health")


@query
def stream_seq_dedup(spark, sf):
    """Reports repeated under one hourly sequence number are kept once."""
    rows = er.signals_of(live_events(spark, sf)).selectExpr(
        "node_id", "boot_id", f"{er.SEGMENT} AS seq", "emitted_ts"
    )
    kept = windows.drop_repeats(rows, "40 days")
    return live_result(spark, kept.select("node_id", "boot_id", "seq"), "dedup")


@query
def stream_tick_windows(spark, sf):
    """Windows as they stand after the last batch, open ones too."""

    def rows_of(events):
        ticks = ticks_view(events).withColumn("overrun", F.col("tick_elapsed_ms") > 3_600_000)
        return windows.tick_windows(ticks, "1 day", "12 hours")

    out = fresh_folder(spark, "windows")
    live_batches(spark, sf, rows_of, stateful.upserts(out), "windows", "update")
    return stateful.latest(spark, out, ["node_id", "window_start"]).select(
        "node_id",
        stamp("window_start").alias("window_start"),
        stamp("window_end").alias("window_end"),
        "ticks",
        "overruns",
        F.round("mean_tick_ms", 3).alias("mean_tick_ms"),
    )


@query
def stream_outage_sessions(spark, sf):
    """Sessions as they stand after the last batch, open ones too."""

    def rows_of(events):
        return er.reports_of(events).select("node_id", "emitted_ts", "health")

    sessions = stateful.OutageSessions(fresh_folder(spark, "sessions"), "2 hours")
    batches = live_batches(spark, sf, rows_of, sessions.process, "sessions")
    return sessions.result(spark, batches).select(
        "node_id",
        stamp("session_start").alias("session_start"),
        stamp("session_end").alias("session_end"),
        "reports",
        "unhealthy",
    )
