"""Small text forms shared by the printed reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigil.functions.numbers import fixed

GIB = float(1024**3)

# Readable names of the reason tags.
REASON_LABELS = {
    "signal:cpu_high": "CPU load high",
    "signal:cpu_critical": "CPU load critical",
    "signal:disk_free_low": "Disk free low",
    "signal:disk_free_critical": "Disk free critical",
    "signal:mem_available_low": "Memory available low",
    "signal:mem_available_critical": "Memory available critical",
}


def or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit("n/a"))


def gib_text(size: Column, unit: str) -> Column:
    """Bytes as GiB: whole from 10 up, one decimal below; null is ``n/a``."""
    gib = size / F.lit(GIB)
    amount = F.when(gib >= 10, fixed(gib, 0)).otherwise(fixed(gib, 1))
    return or_na(F.concat(amount, F.lit(unit)))


def format_gb(size: Column) -> Column:
    return gib_text(size, " GB")


def format_gb_compact(size: Column) -> Column:
    return gib_text(size, "G")


def format_load(load: Column) -> Column:
    return or_na(fixed(load, 2))


def format_pct(pct: Column) -> Column:
    return or_na(F.concat(fixed(pct, 2), F.lit("%")))


def display_seq(seq: Column) -> Column:
    return F.coalesce(seq.cast("string"), F.lit("unknown"))


def trend_direction(slope_per_hr: Column, stable_below: float) -> Column:
    return (
        F.when(F.abs(slope_per_hr) < stable_below, "stable")
        .when(slope_per_hr > 0, "rising")
        .when(slope_per_hr.isNotNull(), "declining")
    )


def trend_label(direction: Column, slope_per_hr: Column, unit: str) -> Column:
    change = F.concat(
        direction, F.lit(" ("), fixed(slope_per_hr, 2, signed=True), F.lit(f" {unit})")
    )
    return F.when(direction == "stable", direction).otherwise(change)


def truncate_message(message: Column, limit: int = 200) -> Column:
    """Messages over ``limit`` characters are cut and say how much was cut."""
    extra = (F.length(message) - limit).cast("string")
    cut = F.concat(
        F.substring(message, 1, limit), F.lit("...[truncated "), extra, F.lit(" chars]")
    )
    return F.when(F.length(message) > limit, cut).otherwise(message)


def reason_label(reason: Column) -> Column:
    """Readable name of a reason tag; an unknown tag stands for itself."""
    labels = F.create_map(*[F.lit(x) for pair in REASON_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, reason), reason)
