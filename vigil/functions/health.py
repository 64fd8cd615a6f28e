"""Threshold evaluation of resource signals to a health verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigil.functions.numbers import percent
from vigil.schema import COLLECTORS

# Default thresholds.
DEFAULT_THRESHOLDS = {
    "cpu_degraded_factor": 0.85,
    "cpu_unhealthy_factor": 1.25,
    "mem_degraded_pct": 15.0,
    "mem_unhealthy_pct": 8.0,
    "disk_degraded_pct": 10.0,
    "disk_unhealthy_pct": 5.0,
}

Thresholds = Mapping[str, "float | Column"]


def _limits(thresholds: Thresholds | None) -> dict[str, Column]:
    """Every threshold as a column; missing keys and null values fall back to defaults."""
    given = thresholds or {}
    limits = {}
    for key, default in DEFAULT_THRESHOLDS.items():
        value = given.get(key)
        if isinstance(value, Column):
            limits[key] = F.coalesce(value, F.lit(default))
        else:
            limits[key] = F.lit(float(default if value is None else value))
    return limits


def cpu_reason(thresholds: Thresholds | None = None) -> Column:
    limit = _limits(thresholds)
    load, cores = F.col("loadavg_1m"), F.col("cpu_count_logical")
    return F.when(
        cores != 0,
        F.when(load > cores * limit["cpu_unhealthy_factor"], "signal:cpu_critical").when(
            load > cores * limit["cpu_degraded_factor"], "signal:cpu_high"
        ),
    )


def mem_reason(thresholds: Thresholds | None = None) -> Column:
    limit = _limits(thresholds)
    pct = percent(F.col("mem_available_bytes"), F.col("mem_total_bytes"))
    return F.when(pct < limit["mem_unhealthy_pct"], "signal:mem_available_critical").when(
        pct < limit["mem_degraded_pct"], "signal:mem_available_low"
    )


def disk_reason(thresholds: Thresholds | None = None) -> Column:
    limit = _limits(thresholds)
    pct = percent(F.col("disk_free_bytes"), F.col("disk_total_bytes"))
    return F.when(pct < limit["disk_unhealthy_pct"], "signal:disk_free_critical").when(
        pct < limit["disk_degraded_pct"], "signal:disk_free_low"
    )


def merge_reasons(*arrays: Column) -> Column:
    """Sorted set union of reason arrays; null entries are dropped."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*arrays))))


def verdict(reasons: Column) -> Column:
    """UNHEALTHY on any critical tag, DEGRADED on any signal or collector tag, else OK."""
    critical = F.exists(reasons, lambda r: F.endswith(r, F.lit("_critical")))
    known = F.exists(
        reasons,
        lambda r: F.startswith(r, F.lit("signal:"))
        | F.startswith(r, F.lit("collector_failed:")),
    )
    return F.when(critical, "UNHEALTHY").when(known, "DEGRADED").otherwise("OK")


def failure_reasons(outcomes: Column, boot_id: Column | None = None) -> Column:
    """Failure tags from ``array<struct<name,ok,…>>``.

    Only collectors whose failure degrades a node count. A null ``boot_id``
    counts as an identity failure; a node without identity emits no report.
    """
    degrading = [n for n, counts in COLLECTORS.items() if counts and n != "identity"]
    failed = F.filter(outcomes, lambda o: ~o["ok"] & o["name"].isin(*degrading))
    tags = F.transform(failed, lambda o: F.concat(F.lit("collector_failed:"), o["name"]))
    if boot_id is not None:
        missing = F.when(boot_id.isNull(), F.lit("collector_failed:identity"))
        tags = F.array_compact(F.concat(tags, F.array(missing)))
    return tags


def evaluate(
    signals: DataFrame,
    thresholds: Thresholds | None = None,
    failures: Column | str | None = None,
    extra_rules: Sequence[tuple[str, Column]] = (),
) -> DataFrame:
    """Add ``reasons`` and ``health`` to a table of signals.

    ``thresholds`` holds numbers or per-row columns. ``extra_rules`` are
    ``(tag, condition)`` pairs for signals of one's own. Works on batch tables
    and on streams alike: it is a projection.
    """
    failed = F.array().cast("array<string>") if failures is None else failures
    failed = F.col(failed) if isinstance(failed, str) else failed
    own = [F.when(condition, F.lit(tag)) for tag, condition in extra_rules]
    found = F.array(
        cpu_reason(thresholds), mem_reason(thresholds), disk_reason(thresholds), *own
    )
    merged = signals.withColumn(
        "reasons", merge_reasons(F.coalesce(failed, F.array().cast("array<string>")), found)
    )
    return merged.withColumn("health", verdict(F.col("reasons")))
