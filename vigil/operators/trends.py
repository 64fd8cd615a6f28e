"""Least-squares trends from mergeable moments.

Expressions are SQL text: there is one set per signal, and one parsed text is
much quicker to build than a tree of column objects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from vigil.functions.numbers import round_exact
from vigil.functions.text import GIB, trend_direction, trend_label

# x is in microseconds
PER_HOUR = 3600.0 * 1_000_000.0


@dataclass(frozen=True)
class Trend:
    """A signal, the unit its slope is shown in, and when it counts as stable."""

    signal: str
    unit: str
    divisor: float
    stable_below: float


# Tracked signals, units and stability limits.
TRENDS = (
    Trend("loadavg_1m", "load/hr", 1.0, 0.1),
    Trend("mem_available_bytes", "GB/hr", GIB, 0.1),
    Trend("disk_free_bytes", "GB/hr", GIB, 0.01),
)


def micros(ts: Column) -> Column:
    """Instant in microseconds, an integer a DOUBLE still holds exactly."""
    return F.unix_micros(ts).cast("double")


def moments(x: str, y: str) -> str:
    """Aggregate: count, means and centred sums of the pairs in which both are present."""
    return (
        f"struct(regr_count({y}, {x}) AS n, regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my,"
        f" regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy)"
    )


def centre(part: str, window: str) -> str:
    """Mean x and y over all parts of a window; null without any pair."""
    total = f"nullif(sum({part}.n) OVER ({window}), 0)"
    return (
        f"struct(sum({part}.mx * {part}.n) OVER ({window}) / {total} AS x,"
        f" sum({part}.my * {part}.n) OVER ({window}) / {total} AS y)"
    )


def merged_slope(part: str, centre: str) -> str:
    """Aggregate: slope over all parts; null for under two points or a single x."""
    dx, dy = f"({part}.mx - {centre}.x)", f"({part}.my - {centre}.y)"
    sxx = f"sum({part}.sxx + {part}.n * {dx} * {dx})"
    sxy = f"sum({part}.sxy + {part}.n * {dx} * {dy})"
    return f"CASE WHEN sum({part}.n) >= 2 AND {sxx} > 0 THEN {sxy} / {sxx} END"


def trend_struct(per_hour: Column, trend: Trend) -> Column:
    """Direction, rounded slope and label; null when there is no slope."""
    direction = trend_direction(per_hour, trend.stable_below)
    return F.when(
        per_hour.isNotNull(),
        F.struct(
            direction.alias("direction"),
            round_exact(per_hour, 3).alias("slope_per_hr"),
            trend_label(direction, per_hour, trend.unit).alias("label"),
        ),
    )


def trend_map(prefix: str) -> Column:
    """Map from signal to trend of the slopes in ``<prefix><signal>`` columns.

    Holds only the signals that have a slope.
    """
    entries = []
    for trend in TRENDS:
        per_hour = F.expr(f"{prefix}{trend.signal} * {PER_HOUR}D / {trend.divisor}D")
        entries += [F.lit(trend.signal), trend_struct(per_hour, trend)]
    return F.map_filter(F.create_map(*entries), lambda _, trend: trend.isNotNull())
