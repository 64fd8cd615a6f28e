"""The triage commands as queries: status, tail, summarize, summarize a folder, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.functions.parse import has_status_fields, with_sections
from vigil.operators import fleet, summarize, validate
from vigil.operators.filters import single_node_files, summary_filter
from vigil.plans import render
from vigil.session import configure, settle
from vigil.sources import ranges, spool

ARRIVAL = spool.ARRIVAL


@dataclass
class Triage:
    """Tables of one summarize run, all over the same written summaries."""

    summaries: DataFrame
    emitted: DataFrame
    meta: DataFrame
    alert: DataFrame

    def render(self, fmt: str = "text", dual: bool = False) -> DataFrame:
        if dual:
            return render.dual(self.emitted, fmt, self.meta)
        return render.document(self.emitted, fmt, self.meta)


def status_lines(reports: DataFrame, fmt: str = "text") -> DataFrame:
    """One status line per report; ``reasons=none`` without reasons."""
    if fmt == "json":
        fields = F.to_json(F.struct("emitted_at", "health", "node_id", "reasons"), {"ignoreNullFields": "false"})
        seq = "seq_json" if "seq_json" in reports.columns else F.col("seq").cast("string")
        text = F.concat(F.expr("left(_fields, length(_fields) - 1)"), F.lit(',"seq":'), F.coalesce(seq, F.lit("null")), F.lit("}"))
        return reports.withColumn("_fields", fields).withColumn("status", text).drop("_fields")
    elif fmt == "text":
        listed = F.array_join("reasons", ",")
        text = F.concat(
            F.lit("node_id="),
            "node_id",
            F.lit(" health="),
            "health",
            F.lit(" seq="),
            F.coalesce("seq_text" if "seq_text" in reports.columns else F.col("seq").cast("string"), F.lit("unknown")),
            F.lit(" emitted_at="),
            "emitted_at",
            F.lit(" reasons="),
            F.when(listed == "", "none").otherwise(listed),
        )
    else:
        raise ValueError("format must be text or json")
    return reports.withColumn("status", text)


def last_valid_reports(parsed: DataFrame) -> DataFrame:
    """The last report of each file that has node, health, seq and time."""
    needed = ("assessment", "identity", "timing")
    complete = with_sections(parsed, only=needed).filter(has_status_fields())
    valid = spool.reports_of(complete.select(*parsed.columns), raw_seq=True)
    whole = [c for c in valid.columns if c != "file_path"]
    last = valid.groupBy("file_path").agg(
        F.max_by(F.struct(*whole), F.struct(*spool.LINE_ORDER)).alias("last")
    )
    return last.select("file_path", "last.*")


def status(spark: SparkSession, path: str, tail: int = 200, fmt: str = "text") -> DataFrame:
    """Status line of the last valid report; a missing spool is an error."""
    configure(spark)
    parsed = spool.tail_spool(spark, path, tail, on_missing="error")
    return status_lines(last_valid_reports(parsed), fmt).select("file_path", "status")


def tail_report(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """Parsed reports in the tail, and seq and health of the last one."""
    configure(spark)
    reports = spool.reports_of(spool.tail_spool(spark, path, n), raw_seq=True)
    return summarize.tail_stats(reports, ARRIVAL)


def legacy(spark: SparkSession, path: str, tail: int = 200) -> DataFrame:
    """One summary over the whole tail, without splitting by node."""
    configure(spark)
    return summarize.legacy_summary(
        spool.reports_of(spool.tail_spool(spark, path, tail)), ARRIVAL
    )


def summarize_spools(
    spark: SparkSession,
    path: str,
    tail: int = 200,
    top_k: int | None = 5,
    glob: str | None = None,
    computed_at: str = "",
    one_node_per_file: str | None = None,
    by_ranges: bool = False,
    **conditions,
) -> Triage:
    """Summaries of one spool, or of a folder of spools when ``glob`` is given.

    ``one_node_per_file`` is ``raise`` or ``drop`` to enforce that every file
    names a single node; None, as for a live view, does not check. ``by_ranges`` finds the
    tails from the ends of the files instead of scanning them, and takes hidden files too.
    """
    configure(spark)
    keep = summary_filter(**conditions)
    # the spools are scanned once; everything below reads their tails or the summaries
    if by_ranges:
        ends = ranges.tail_lines(spark, path, tail, glob or "*")
    else:
        ends = spool.tail_lines(spool.read_lines(spark, path, glob), tail)
    tails = settle(ends, "tails")
    parsed = spool.parse_lines(tails)
    reports = spool.reports_of(parsed)
    if one_node_per_file is not None:
        reports = single_node_files(reports, one_node_per_file)
    # a node may own many files; each file's tail is one segment of its history
    table = summarize.summarize_by_node(reports, top_k, ARRIVAL, segment="file_path")
    summaries = settle(table, "summaries")
    extra: dict[str, str | int] = {"spool_path": path}
    if glob is not None:
        seen = ranges.list_files(spark, path, glob).count() if by_ranges else spool.count_files(spark, path, glob)
        extra = {"spool_dir": path, "files_seen": seen}
    meta = fleet.summary_meta(
        summaries, keep, tail, computed_at, spool.invalid_counts(parsed), **extra
    )
    if glob is not None:
        meta = meta.withColumn("reports_invalid_total", F.col("reports_invalid"))
    emitted = summaries.filter(keep)
    filtered = bool(conditions.get("only_degraded") or conditions.get("only_unhealthy"))
    return Triage(summaries, emitted, meta, fleet.alert_code(emitted, filtered))


def summarize_folder(
    spark: SparkSession, path: str, tail: int = 200, glob: str = "*.jsonl", **options
) -> Triage:
    """Fleet summary over the spools of a folder, one node per file."""
    options.setdefault("one_node_per_file", "raise")
    return summarize_spools(spark, path, tail, glob=glob, **options)


def validate_spool(spark: SparkSession, path: str, n: int = 200) -> DataFrame:
    """Checked lines of a spool's tail; a missing spool is an error."""
    configure(spark)
    return validate.validate_tail(spool.read_lines(spark, path, on_missing="error"), n)
