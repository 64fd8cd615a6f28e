"""Exact order statistics of groups of any size.

``percentile_disc`` and a window over a group keep all its distinct values in one
task. Here values are counted per group, the counts are cut into ranges of the
order, and only the one range that holds a wanted rank is summed row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.session import settle


def counted_values(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Sequence[Column] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Distinct values per group with ``_n``, how often they occur, and ``_range``, written once.

    ``extra`` are further aggregates per group and value. Ranges follow (keys, value), so a
    group with a third of all distinct values is cut into a third of the ranges, which
    default to the number of shuffle partitions. The ranges are columns of the written
    table, so a task that is run again reads the same ones.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), *extra)
    placed = counted.repartitionByRange(ranges, *keys, value)
    return settle(placed.withColumn("_range", F.spark_partition_id()), "values")


def disc_percentiles(
    counted: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float | str]
) -> DataFrame:
    """Per group the smallest value with at least the given share of rows at or below it.

    ``counted`` comes from ``counted_values``; ``shares`` maps result columns to shares from 0
    to 1, taken as decimals, so that 0.95 of 20 rows is row 19. Null values are left out; a
    group without others is not in the result. Groups with null keys are groups like others.
    """
    keys = list(keys)
    known = counted.where(F.col(value).isNotNull())
    sizes = known.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    # one row per group and range, at most as many per group as there are ranges
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "*",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias("_all"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _rank(F.col("_all"), share).alias("rank"))
            for name, share in shares.items()
        ]
    )
    held = F.filter(
        wanted,
        lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_size")),
    )
    found = sizes.select(*keys, "_range", "_before", held.alias("_wanted")).where(F.size("_wanted") > 0)
    rows = _with(known.select(*keys, "_range", value, "_n"), found, [*keys, "_range"])
    within = Window.partitionBy(*keys, "_range").orderBy(value)
    upto = F.col("_before") + F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select(*keys, value, "_n", "_wanted", upto.alias("_upto"))
    first = F.col("_upto") - F.col("_n")

    def at(name: str) -> Column:
        mine = F.exists(
            "_wanted",
            lambda w: (w["name"] == name) & (w["rank"] > first) & (w["rank"] <= F.col("_upto")),
        )
        return F.max(F.when(mine, F.col(value))).alias(name)

    return placed.groupBy(*keys).agg(*[at(name) for name in shares])


def ranked(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "place",
    ranges: int | None = None,
) -> DataFrame:
    """Number rows 1, 2, … per group in ``order``; without ``keys`` all rows are one group.

    Rows are written once in ranges of (keys, order) and numbered within their range; what comes
    before it in the group is known from the sizes of the ranges, so a group of any size is
    spread over tasks. Rows that ``order`` does not tell apart are numbered in any order.
    """
    spark, keys = rows.sparkSession, list(keys)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *keys, *order)
    placed = settle(placed.withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    # one row per group and range
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbered = placed.withColumn("_at", within)
    joined = _with(numbered, sizes, [*keys, "_range"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at")).cast("bigint").alias(name))


def _with(rows: DataFrame, figures: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows joined with figures of their range; a null key matches itself."""
    names = {name: f"_on_{i}" for i, name in enumerate(on)}
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    return rows.join(figures.withColumnsRenamed(names), same).drop(*names.values())


def _rank(size: Column, share: float | str) -> Column:
    """Rank, from 1, of the value with ``share`` of ``size`` rows at or below it."""
    exact = Decimal(str(share))
    if not 0 <= exact <= 1:
        raise ValueError("a share lies between 0 and 1")
    whole, parts = exact.as_integer_ratio()
    # ceil(size * whole / parts) in whole numbers
    up = F.call_function("div", size * F.lit(whole) + F.lit(parts - 1), F.lit(parts))
    return F.greatest(F.lit(1).cast("bigint"), up)
