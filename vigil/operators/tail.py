"""The last n rows of every group, without moving whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.session import settle

# Parts into which a group is spread for the first cut.
SPREAD = 32
# Steps into which the range of the order is cut to find where tails begin.
STEPS = 4096


def tail_rows(
    rows: DataFrame,
    n: int,
    keys: Sequence[str],
    order: Sequence[str],
    spread: Column | None = None,
    rank: str = "tail_rank",
) -> DataFrame:
    """Keep the last ``n`` rows of each group in ascending ``order``.

    ``rank`` counts back from the last row (1). Both ranks are plain row
    numbers under a limit, so Spark cuts to n rows per group in every task
    before each shuffle. The first cut spreads a group over several tasks:
    a group present in very many input tasks would otherwise send n rows from
    each of them to a single one. The result does not depend on the spreading,
    which is a hash of the order, so filters on the keys reach the scan.
    """
    if n <= 0:
        return rows.limit(0).withColumn(rank, F.lit(None).cast("int"))
    last_first = [F.col(c).desc() for c in order]
    part = F.pmod(F.xxhash64(*order), F.lit(SPREAD)) if spread is None else spread
    first_cut = Window.partitionBy(*keys, "_part").orderBy(*last_first)
    kept = (
        rows.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(first_cut))
        .filter(F.col("_rank") <= n)
        .drop("_part", "_rank")
    )
    final_cut = Window.partitionBy(*keys).orderBy(*last_first)
    return kept.withColumn(rank, F.row_number().over(final_cut)).filter(F.col(rank) <= n)


def large_tails(rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Keep the last ``n`` rows of each group in ascending ``order``, for an n of any size.

    The first column of ``order`` is an integer or a timestamp. Rows are counted per group and step of its
    range, and the counts tell in which step a group's tail begins. Rows of later steps are kept as they
    are, without a shuffle; only those of that one step are ranked. While these steps hold more than n
    rows together, they are counted again in finer ones. The earliest beginning of all tails limits the scan.
    Rows without a value in that column come before all others.
    """
    if n <= 0:
        return rows.limit(0)
    first, keys = order[0], list(keys)
    if not keys:  # one group of all rows
        return large_tails(rows.withColumn("_all", F.lit(1)), n, ["_all"], order, steps).drop("_all")
    is_time = rows.schema[first].dataType.typeName().startswith("timestamp")
    value = F.unix_micros(first) if is_time else F.col(first).cast("long")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return tail_rows(rows, n, keys, order).drop("tail_rank")
    base = low - 1
    placed = rows.withColumn("_place", F.coalesce(value, F.lit(base)))
    width = max(1, -(-(high - base + 1) // steps))
    groups = _beginnings(placed.select(*keys, "_place", F.lit(base).alias("_begin"), F.lit(n).cast("long").alias("_wanted")), keys, width)
    while True:
        held, earliest = groups.agg(F.sum("_held"), F.min("_begin")).first()
        if width == 1 or held <= n:
            break
        cut = _with_groups(placed, groups.where("_held > 0"), keys)
        inside = cut.where((F.col("_place") >= F.col("_begin")) & (F.col("_place") < F.col("_begin") + width))
        whole = groups.where("_held = 0")
        width = max(1, -(-width // steps))
        finer = _beginnings(inside.select(*keys, "_place", "_begin", "_wanted"), keys, width)
        groups = settle(finer.unionByName(whole), "beginnings")
    if earliest > base:
        limit = F.timestamp_micros(F.lit(earliest)) if is_time else F.lit(earliest)
        placed = placed.where(F.col(first) >= limit)
    found = _with_groups(placed, groups, keys)
    ends = F.col("_begin") + F.when(F.col("_held") > 0, width).otherwise(0)
    surely = found.where(F.col("_place") >= ends)
    between = found.where((F.col("_place") >= F.col("_begin")) & (F.col("_place") < ends))
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    ranked = between.withColumn("_rank", F.row_number().over(last_first)).where(F.col("_rank") <= F.col("_wanted"))
    return surely.select(*rows.columns).unionByName(ranked.select(*rows.columns))


def _beginnings(placed: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per group the step in which its tail begins, how many rows are wanted of it, and how many it holds.

    ``_held`` is 0 for a group that is kept as a whole.
    """
    step = F.floor((F.col("_place") - F.col("_begin")) / width).alias("_step")
    counted = placed.groupBy(*keys, "_begin", "_wanted", step).agg(F.count(F.lit(1)).alias("_rows"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    seen = counted.withColumn("_seen", F.sum("_rows").over(later))
    left = F.col("_wanted") - F.col("_seen") + F.col("_rows")
    at = F.max(F.when(F.col("_seen") >= F.col("_wanted"), F.struct("_step", left.alias("left"), F.col("_rows").alias("rows"))))
    found = seen.groupBy(*keys, "_begin").agg(at.alias("at"))
    return settle(
        found.select(
            *keys,
            (F.col("_begin") + F.coalesce("at._step", F.lit(0)) * width).alias("_begin"),
            F.coalesce("at.left", F.lit(0)).cast("long").alias("_wanted"),
            F.coalesce("at.rows", F.lit(0)).cast("long").alias("_held"),
        ),
        "beginnings",
    )


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's figures; Spark picks the join by the size of the groups' table."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in names.items()]
    return rows.join(groups.withColumnsRenamed(names), same)
