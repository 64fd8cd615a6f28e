"""Timing of the agent loop: drift, overruns, collector durations, event-log roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigil.operators.ordered import with_previous
from vigil.operators.ranks import counted_values, disc_percentiles


def tick_timing(
    ticks: DataFrame,
    order: Sequence[str],
    segment: str,
    start: str = "tick_start",
    keys: Sequence[str] = ("node_id",),
) -> DataFrame:
    """Add ``sleep_drift_ms``, ``overrun`` and ``sleep_ms`` to ticks.

    Drift is how much later than previous start plus interval a tick began;
    never negative, and 0 for the first tick. Needs ``interval_s`` and
    ``tick_elapsed_ms``.
    """
    rows = with_previous(ticks, keys, order, segment, [start])
    late = F.unix_micros(start) - F.unix_micros(f"prev_{start}")
    late = late - F.col("interval_s") * F.lit(1_000_000).cast("bigint")
    # whole milliseconds, cut towards zero
    drift = F.when(F.col("has_prev") & (late > 0), F.floor(late / 1000)).otherwise(0)
    interval_ms = F.col("interval_s") * F.lit(1000).cast("bigint")
    return (
        rows.withColumn("sleep_drift_ms", drift.cast("bigint"))
        .withColumn("overrun", F.col("tick_elapsed_ms") > interval_ms)
        .withColumn(
            "sleep_ms", F.greatest(F.lit(0).cast("bigint"), interval_ms - F.col("tick_elapsed_ms"))
        )
        .drop("has_prev", f"prev_{start}")
    )


def collector_totals(durations: Column) -> Column:
    """Total and slowest of ``array<struct<name,ms>>`` in run order.

    The first of equally slow collectors wins.
    """
    total = F.aggregate(durations, F.lit(0).cast("bigint"), lambda s, d: s + d["ms"])
    worst = F.array_max(F.transform(durations, lambda d: d["ms"]))
    slowest = F.filter(durations, lambda d: d["ms"] == worst)[0]
    return F.struct(
        total.alias("collector_total_ms"),
        F.when(F.size(durations) > 0, slowest["name"]).alias("slowest_collector_name"),
        worst.cast("bigint").alias("slowest_collector_ms"),
    )


def tick_rollup(ticks: DataFrame, window: str = "1 day", keys: Sequence[str] = ("node_id",)):
    """Tick figures per key and time window: overruns, mean, median and tail durations.

    Needs ``tick_start``, ``tick_elapsed_ms``, ``sleep_drift_ms`` and ``overrun``. Ticks are
    read once and counted per duration; all figures come from these counts, and the exact
    percentiles from ranges of them, so no task holds all durations of a group. Ticks without
    a start are in no window; those without a duration count, but have no part in its figures.
    """
    group = [*keys, "window"]
    ms = F.col("tick_elapsed_ms")
    timed = ticks.withColumn("window", F.window("tick_start", window))
    counted = counted_values(
        timed,
        group,
        "tick_elapsed_ms",
        [F.count_if("overrun").alias("overruns"), F.max("sleep_drift_ms").alias("drift")],
    )
    figures = counted.groupBy(*group).agg(
        F.sum("_n").alias("ticks"),
        F.sum("overruns").alias("overruns"),
        (F.sum(ms.cast("double") * F.col("_n")) / F.sum(F.when(ms.isNotNull(), F.col("_n")))).alias(
            "mean_tick_ms"
        ),
        F.max(ms).alias("max_tick_ms"),
        F.max("drift").alias("max_drift_ms"),
    )
    shares = disc_percentiles(counted, group, "tick_elapsed_ms", {"p50": "0.5", "p95": "0.95"})
    names = {name: f"_of_{i}" for i, name in enumerate(group)}
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    return figures.join(shares.withColumnsRenamed(names), same, "left").select(
        *keys,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "ticks",
        "overruns",
        (F.col("overruns") / F.col("ticks")).alias("overrun_rate"),
        "mean_tick_ms",
        F.col("p50").cast("bigint").alias("p50_tick_ms"),
        F.col("p95").cast("bigint").alias("p95_tick_ms"),
        "max_tick_ms",
        "max_drift_ms",
    )


def collector_failures(events: DataFrame) -> DataFrame:
    """``collector_failed`` events per collector and error type."""
    failed = events.filter(F.col("event_type") == "collector_failed")
    return failed.groupBy("collector", "error_type").agg(F.count(F.lit(1)).alias("failures"))
