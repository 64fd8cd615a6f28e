"""Report sequence numbers: assignment and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vigil.operators.ordered import run_position, with_previous


def assign_seq(
    reports: DataFrame,
    order: Sequence[str],
    segment: str,
    name: str = "assigned_seq",
) -> DataFrame:
    """Number each node's reports from 1, starting again when the boot changes.

    A report without boot id always gets 1 and leaves the numbering alone.
    """
    boot = F.coalesce(F.trim("boot_id"), F.lit(""))
    known = reports.filter(boot != "").withColumn("_boot", boot)
    numbered = run_position(known, ["node_id"], order, segment, "_boot", name).drop("_boot")
    blank = reports.filter(boot == "").withColumn(name, F.lit(1).cast("bigint"))
    return numbered.unionByName(blank)


def sequence_steps(
    reports: DataFrame, order: Sequence[str], segment: str, seq: str = "seq"
) -> DataFrame:
    """Classify each report's step from the node's previous one.

    ``first``, ``restart`` (other boot), ``next``, ``gap``, ``duplicate`` or
    ``regression``; ``missed`` is how many numbers a gap skipped.
    """
    rows = reports.select(
        *dict.fromkeys(["node_id", "boot_id", *order, segment, seq])
    )
    rows = with_previous(rows, ["node_id"], order, segment, ["boot_id", seq])
    change = F.col(seq) - F.col(f"prev_{seq}")
    step = (
        F.when(~F.col("has_prev"), "first")
        .when(~F.col("boot_id").eqNullSafe(F.col("prev_boot_id")), "restart")
        .when(change == 1, "next")
        .when(change > 1, "gap")
        .when(change == 0, "duplicate")
        .when(change < 0, "regression")
        .otherwise("unknown")
    )
    return rows.withColumn("step", step).withColumn(
        "missed", F.when(F.col("step") == "gap", change - 1).otherwise(0)
    )


def sequence_audit(steps: DataFrame) -> DataFrame:
    """Gaps, skipped numbers, duplicates, regressions and restarts per node."""
    def steps_of(kind: str):
        return F.count_if(F.col("step") == kind)

    return steps.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("reports"),
        steps_of("gap").alias("gaps"),
        F.sum("missed").alias("missed"),
        steps_of("duplicate").alias("duplicates"),
        steps_of("regression").alias("regressions"),
        steps_of("restart").alias("restarts"),
    )
