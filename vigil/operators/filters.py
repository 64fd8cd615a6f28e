"""Filters over node summaries and fleet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def summary_filter(
    node: str | None = None,
    only_degraded: bool = False,
    only_unhealthy: bool = False,
    min_degraded_count: int | None = None,
) -> Column:
    """All given conditions together; no node or an empty one does not filter."""
    if only_degraded and only_unhealthy:
        raise ValueError("only_degraded and only_unhealthy are mutually exclusive")
    if min_degraded_count is not None and min_degraded_count < 1:
        raise ValueError("min_degraded_count must be at least 1")
    keep = F.lit(True)
    if node:
        keep = keep & (F.col("node_id") == node)
    if only_degraded:
        keep = keep & (F.col("current_health") == "DEGRADED")
    if only_unhealthy:
        keep = keep & (F.col("current_health") == "UNHEALTHY")
    if min_degraded_count is not None:
        keep = keep & (F.col("degraded_count_tail") >= min_degraded_count)
    return keep


def filter_summaries(summaries: DataFrame, **conditions) -> DataFrame:
    return summaries.filter(summary_filter(**conditions))


def multi_node_files(reports: DataFrame, file: str = "file_path") -> DataFrame:
    """Files whose reports name more than one node; reports without a node do not count.

    Comparing the smallest with the largest id needs no distinct set per file.
    """
    node = F.col("node_id_raw" if "node_id_raw" in reports.columns else "node_id")
    return (
        reports.groupBy(file)
        .agg(F.min(node).alias("first_node"), F.max(node).alias("last_node"))
        .filter(F.col("first_node") != F.col("last_node"))
    )


def single_node_files(
    reports: DataFrame, on_violation: str = "raise", file: str = "file_path"
) -> DataFrame:
    """Enforce one node per file: ``raise`` an error, or ``drop`` the offending files."""
    offending = multi_node_files(reports, file)
    if on_violation == "raise":
        first = offending.select(file).take(1)
        if first:
            raise ValueError(f"spool file contains multiple node_id values: {first[0][0]}")
        return reports
    if on_violation == "drop":
        return reports.join(offending.select(file), file, "left_anti")
    raise ValueError("on_violation must be 'raise' or 'drop'")
