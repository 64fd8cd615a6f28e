"""Alerts on health that stays bad."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from vigil.operators.ordered import islands

# How long a state must hold before it alerts, in seconds.
HOLD_SECONDS = {"UNHEALTHY": 300, "DEGRADED": 600}


def sustained_alerts(
    reports: DataFrame,
    order: Sequence[str],
    segment: str,
    time: str = "emitted_ts",
    hold: Mapping[str, int] = HOLD_SECONDS,
) -> DataFrame:
    """Runs in which a node reported one bad state without a break for long enough."""
    runs = islands(reports, ["node_id"], order, segment, "health", time)
    lasted = F.unix_micros("end") - F.unix_micros("start")
    long_enough = F.lit(False)
    for health, seconds in hold.items():
        long_enough = long_enough | (
            (F.col("health") == health) & (lasted >= F.lit(seconds * 1_000_000))
        )
    return runs.filter(long_enough).select(
        "node_id", "health", "start", "end", F.col("rows").alias("reports"),
        (lasted / F.lit(1_000_000.0)).alias("seconds"),
    )
