"""Live operators on Spark's own streaming state: duplicates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def drop_repeats(
    reports: DataFrame, late: str = "1 hour", time: str = "emitted_ts"
) -> DataFrame:
    """Keep one report per node, boot and seq among those within ``late``."""
    return reports.withWatermark(time, late).dropDuplicatesWithinWatermark(
        ["node_id", "boot_id", "seq"]
    )


def tick_windows(
    ticks: DataFrame,
    size: str = "1 day",
    slide: str | None = None,
    late: str = "1 hour",
    time: str = "tick_start",
) -> DataFrame:
    """Overruns and mean duration of ticks per node and time window.

    In update mode a batch gives the windows that it changed, open ones too: see ``stateful.upserts``.
    """
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = (
        ticks.withWatermark(time, late)
        .groupBy("node_id", window.alias("window"))
        .agg(
            F.count(F.lit(1)).alias("ticks"),
            F.count_if("overrun").alias("overruns"),
            F.avg("tick_elapsed_ms").alias("mean_tick_ms"),
        )
    )
    return counted.select(
        "node_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "ticks",
        "overruns",
        "mean_tick_ms",
    )
