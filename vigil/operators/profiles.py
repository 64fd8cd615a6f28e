"""Reports evaluated under the threshold profile they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.functions.health import DEFAULT_THRESHOLDS, evaluate

# Profiles beyond this number are joined by shuffling instead of broadcasting.
MAX_BROADCAST_PROFILES = 50_000


def small_enough(table: DataFrame, limit: int = MAX_BROADCAST_PROFILES) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than it must."""
    return table.limit(limit + 1).count() <= limit


def with_thresholds(
    reports: DataFrame,
    thresholds: DataFrame,
    on: str = "threshold_profile",
    limit: int = MAX_BROADCAST_PROFILES,
) -> DataFrame:
    """Left join of each report with its profile's six limits (``t_…`` columns).

    The table is broadcast only once its row count is known to be small. Past
    that it is joined by shuffle, where adaptive execution splits the partition
    of a profile that most reports share.
    """
    side = thresholds.select(
        F.col("profile").alias(on), *[F.col(k).alias(f"t_{k}") for k in DEFAULT_THRESHOLDS]
    )
    if small_enough(side, limit):
        side = F.broadcast(side)
    return reports.join(side, on, "left")


def evaluate_by_profile(
    signals: DataFrame,
    thresholds: DataFrame,
    failures=None,
    on: str = "threshold_profile",
    limit: int = MAX_BROADCAST_PROFILES,
) -> DataFrame:
    """Verdicts under each report's own profile; unknown profiles use the defaults."""
    joined = with_thresholds(signals, thresholds, on, limit)
    columns = {key: F.col(f"t_{key}") for key in DEFAULT_THRESHOLDS}
    judged = evaluate(joined, columns, failures)
    return judged.drop(*[f"t_{key}" for key in DEFAULT_THRESHOLDS])


def verdict_changes(judged: DataFrame, thresholds, failures=None) -> DataFrame:
    """Stored verdict (``health``) next to the one under other thresholds (``new_health``)."""
    stored = judged.withColumnsRenamed({"health": "_health", "reasons": "_reasons"})
    again = evaluate(stored, thresholds, failures)
    return again.withColumnsRenamed({"health": "new_health", "reasons": "new_reasons"}).withColumnsRenamed(
        {"_health": "health", "_reasons": "reasons"}
    )


def verdict_matrix(changes: DataFrame) -> DataFrame:
    """How many reports move from each stored verdict to each new one."""
    return changes.groupBy("health", "new_health").agg(F.count(F.lit(1)).alias("reports"))
