"""Fleet-level figures over node summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fleet_rollup(summaries: DataFrame) -> DataFrame:
    """One row: nodes per current health, and whether any is in trouble."""
    health = F.col("current_health")

    def nodes(value: str) -> Column:
        return F.count_if(health == value)

    return summaries.agg(
        F.count(F.lit(1)).alias("nodes"),
        nodes("OK").alias("ok_nodes"),
        nodes("DEGRADED").alias("degraded_nodes"),
        nodes("UNHEALTHY").alias("unhealthy_nodes"),
        F.coalesce(F.bool_or(health == "DEGRADED"), F.lit(False)).alias("any_degraded"),
        F.coalesce(F.bool_or(health == "UNHEALTHY"), F.lit(False)).alias("any_unhealthy"),
    )


def alert_code(emitted: DataFrame, filtered: bool = True) -> DataFrame:
    """One row: 3 if an emitted node is UNHEALTHY, else 2 if one is DEGRADED, else 0.

    Codes only apply when a health filter is active; otherwise the code is 0.
    """
    health = F.col("current_health")
    code = (
        F.when(F.bool_or(health == "UNHEALTHY"), 3)
        .when(F.bool_or(health == "DEGRADED"), 2)
        .otherwise(0)
    )
    if not filtered:
        code = F.coalesce(F.min(F.lit(0)), F.lit(0))
    return emitted.agg(code.alias("alert_code"))


def summary_meta(
    summaries: DataFrame,
    keep: Column,
    tail_n: int,
    computed_at: str,
    line_counts: DataFrame | None = None,
    **extra: str | int,
) -> DataFrame:
    """One row describing a summary run.

    ``nodes_seen_tail`` counts before the filter ``keep``, ``nodes_emitted``
    after it. ``line_counts`` has parsed and invalid lines per file; without it
    the reports seen by the summaries are counted.
    """
    nodes = summaries.agg(
        F.count(F.lit(1)).alias("nodes_seen_tail"),
        F.count_if(keep).alias("nodes_emitted"),
        F.coalesce(F.sum("reports_seen_tail"), F.lit(0)).alias("reports_parsed"),
    )
    invalid = F.lit(0).cast("bigint")
    if line_counts is not None:
        totals = line_counts.agg(F.coalesce(F.sum("reports_invalid"), F.lit(0)).alias("n"))
        invalid = totals.scalar()
    return nodes.select(
        F.lit("1").alias("schema_version"),
        F.lit(tail_n).alias("tail_n"),
        "nodes_seen_tail",
        "nodes_emitted",
        "reports_parsed",
        invalid.alias("reports_invalid"),
        F.lit(computed_at).alias("computed_at"),
        *[F.lit(value).alias(name) for name, value in extra.items()],
    )


def mixed_thresholds(latest: DataFrame) -> DataFrame:
    """One row: do the nodes' newest reports disagree on their threshold hash?

    Counting nodes per hash first keeps the distinct hashes out of one task.
    """
    per_hash = (
        latest.filter(F.coalesce("thresholds_hash", F.lit("")) != "")
        .groupBy("thresholds_hash")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )
    return per_hash.agg(
        F.count(F.lit(1)).alias("distinct_hashes"),
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes_with_hash"),
        F.max_by("thresholds_hash", F.struct(F.col("nodes"), F.col("thresholds_hash"))).alias(
            "most_common_hash"
        ),
        (F.count(F.lit(1)) > 1).alias("mixed"),
    )
