"""Report records: assembly from signals and canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.schema import SCHEMA_VERSION, SIGNALS


def _lit_or_col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def assemble(
    signals: DataFrame,
    agent_version: Column | str = "0.1.0",
    threshold_profile: Column | str = "default",
    thresholds_hash: Column | str = "",
) -> DataFrame:
    """Add a nested ``report`` struct with its fields in alphabetical order."""
    present = sorted(name for name in SIGNALS if name in signals.columns)
    report = F.struct(
        F.struct(F.col("health"), F.array_sort("reasons").alias("reasons")).alias("assessment"),
        F.struct(F.col("boot_id"), F.col("node_id")).alias("identity"),
        F.struct(
            _lit_or_col(agent_version).alias("agent_version"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            _lit_or_col(threshold_profile).alias("threshold_profile"),
            _lit_or_col(thresholds_hash).alias("thresholds_hash"),
        ).alias("meta"),
        F.struct(*[F.col(name) for name in present]).alias("signals"),
        F.struct(F.col("emitted_at"), F.col("seq")).alias("timing"),
    )
    return signals.withColumn("report", report)


def report_json(report: Column) -> Column:
    """One-line JSON, keys sorted, no blanks; null signals are left out."""
    return F.to_json(report)


def builder_error(report: Column) -> Column:
    """First violated rule of an assembled report, or null when it may be emitted."""
    def empty(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) == ""

    seq = report["timing"]["seq"]
    health = report["assessment"]["health"]
    version = report["meta"]["schema_version"]
    return F.coalesce(
        F.when(empty(report["identity"]["node_id"]), "identity.node_id is empty"),
        F.when(F.coalesce(seq, F.lit(0)) < 1, "timing.seq must be >= 1"),
        F.when(empty(report["timing"]["emitted_at"]), "timing.emitted_at is empty"),
        F.when(
            ~F.coalesce(health.isin("OK", "DEGRADED", "UNHEALTHY"), F.lit(False)),
            "assessment.health must be: ['DEGRADED', 'OK', 'UNHEALTHY']",
        ),
        F.when(
            F.coalesce(version, F.lit("")) != SCHEMA_VERSION,
            f"meta.schema_version must be: '{SCHEMA_VERSION}'",
        ),
        F.when(empty(report["meta"]["agent_version"]), "meta.agent_version must be non-empty"),
        F.when(report["signals"].isNull(), "signals must be a dict"),
    )


def checked(assembled: DataFrame) -> DataFrame:
    """Fail the job on the first report that breaks a builder rule."""
    error = builder_error(F.col("report"))
    return assembled.withColumn(
        "report", F.when(error.isNull(), F.col("report")).otherwise(F.raise_error(error))
    )
