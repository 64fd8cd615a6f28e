"""Order-dependent operators over whole histories.

A window over a node's entire history puts that node into one task. Here a
history is cut into segments (a file, an hour, …) whose order agrees with the
row order. Windows run inside ``(keys, segment)``; only one summary row per
segment is then ordered per key to carry values across segment borders. The
results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def time_segment(ts: str | Column, seconds: int = 3600) -> Column:
    """Segment number of an instant: how many whole ``seconds`` since the epoch.

    Choose the width so that the busiest key stays within some million rows.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def _inner(keys: Sequence[str], segment: str, order: Sequence[str]):
    return Window.partitionBy(*keys, segment).orderBy(*order)


def _join_segments(
    rows: DataFrame, carried: DataFrame, keys: Sequence[str], segment: str
) -> DataFrame:
    """Left join of one ``carried`` row per segment; a null key or segment matches itself."""
    on = [*keys, segment]
    side = carried.withColumnsRenamed({name: f"_on_{name}" for name in on})
    same = [F.col(name).eqNullSafe(F.col(f"_on_{name}")) for name in on]
    return rows.join(side, same, "left").drop(*[f"_on_{name}" for name in on])


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add the previous row's ``columns`` per key, and ``has_prev``.

    Rows that follow another one inside their segment are done there. First and
    last rows of segments, at most two each, are ordered per key once more. Both
    parts read the same columns, so they share one scan and one shuffle.
    """
    inner = _inner(keys, segment, order)
    value = F.struct(*columns)
    marked = rows.select(
        "*",
        F.lag(value).over(inner).alias("_before"),
        (F.row_number().over(inner) == 1).alias("_first"),
        F.lead(F.lit(True)).over(inner).isNull().alias("_last"),
    )
    inside = marked.filter(~F.col("_first"))
    by_key = Window.partitionBy(*keys).orderBy(segment, *order)
    border = marked.filter(F.col("_first") | F.col("_last"))
    # a first row has no "_before" yet; naming it keeps the columns of both parts alike
    carried = F.coalesce(F.col("_before"), F.lag(value).over(by_key))
    firsts = border.withColumn("_before", carried).filter("_first")
    both = inside.unionByName(firsts)
    return both.select(
        *[F.col(c) for c in rows.columns],
        F.col("_before").isNotNull().alias("has_prev"),
        *[F.col("_before").getField(c).alias(f"{prefix}{c}") for c in columns],
    )


def run_position(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    value: str,
    name: str = "position",
) -> DataFrame:
    """Number rows 1, 2, … per key, starting again whenever ``value`` changes.

    Rows after a change inside their segment count from it. The others go on
    from the run left open by the segments before, if that has the same value.
    """
    inner = _inner(keys, segment, order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        "*",
        F.row_number().over(inner).alias("_at"),
        F.lag(value).over(inner).alias("_before"),
        F.first(value).over(so_far).alias("_head"),
        F.lead(F.lit(True)).over(inner).isNull().alias("_last"),
    )
    changed = (F.col("_at") > 1) & ~F.col(value).eqNullSafe(F.col("_before"))
    marked = placed.withColumn(
        "_start", F.max(F.when(changed, F.col("_at"))).over(so_far)
    ).drop("_before")

    # one row per segment: its first and last value and the length of its last run
    ends = marked.filter("_last").select(
        *keys,
        segment,
        "_head",
        F.col(value).alias("_tail"),
        F.col("_start").isNotNull().alias("_closed"),
        (F.col("_at") - F.coalesce(F.col("_start") - 1, F.lit(0))).alias("_open"),
    )
    by_key = Window.partitionBy(*keys).orderBy(segment)
    goes_on = F.coalesce(F.col("_head").eqNullSafe(F.lag("_tail").over(by_key)), F.lit(False))
    goes_on = goes_on & (F.row_number().over(by_key) > 1)
    ends = ends.withColumn("_goes_on", goes_on)
    # segments that are one run continuing the one before add up
    fresh = F.col("_closed") | ~F.col("_goes_on")
    ends = ends.withColumn("_group", F.sum(fresh.cast("int")).over(by_key))
    grouped = Window.partitionBy(*keys, "_group").orderBy(segment)
    ends = ends.withColumn("_open", F.sum("_open").over(grouped))
    carried = ends.select(
        *keys,
        segment,
        F.when(F.col("_goes_on"), F.lag("_open").over(by_key)).otherwise(0).alias("_carried"),
    )
    joined = _join_segments(marked, carried, keys, segment)
    position = F.when(F.col("_start").isNull(), F.col("_carried") + F.col("_at")).otherwise(
        F.col("_at") - F.col("_start") + 1
    )
    return joined.select(*[F.col(c) for c in rows.columns], position.cast("bigint").alias(name))


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    name: str = "number",
) -> DataFrame:
    """Number rows 1, 2, … per key in ``order``."""
    inside = rows.withColumn("_at", F.row_number().over(_inner(keys, segment, order)))
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = rows.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys, segment, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    joined = _join_segments(inside, offsets, keys, segment)
    return joined.withColumn(name, F.col("_offset") + F.col("_at")).drop("_at", "_offset")


def islands(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: str,
    value: str,
    time: str,
) -> DataFrame:
    """Unbroken runs of one ``value`` per key: start, end and number of rows.

    Runs strictly inside a segment are complete. Only the first and the last
    run of each segment are compared with their neighbours.
    """
    inner = _inner(keys, segment, order)
    before = F.lag(value).over(inner)
    starts = F.when(
        (F.row_number().over(inner) == 1) | ~F.col(value).eqNullSafe(before), 1
    ).otherwise(0)
    needed = list(dict.fromkeys([*keys, segment, *order, value, time]))
    marked = rows.select(*needed).withColumn("_starts", starts)
    marked = marked.withColumn(
        "_run",
        F.sum("_starts").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    runs = marked.groupBy(*keys, segment, "_run", value).agg(
        F.min(time).alias("start"),
        F.max(time).alias("end"),
        F.count(F.lit(1)).alias("rows"),
    )
    runs = runs.withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys, segment)))
    at_border = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    closed = runs.filter(~at_border).select(*keys, value, "start", "end", "rows")
    by_key = Window.partitionBy(*keys).orderBy(segment, "_run")
    border = runs.filter(at_border)
    # in a segment's last run the one before is its own first run, or hidden in between
    joins_on = (
        (F.col("_run") == 1)
        & (F.row_number().over(by_key) > 1)
        & F.col(value).eqNullSafe(F.lag(value).over(by_key))
    )
    border = border.withColumn("_new", F.when(joins_on, 0).otherwise(1))
    border = border.withColumn("_island", F.sum("_new").over(by_key))
    merged = border.groupBy(*keys, "_island", value).agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("rows").alias("rows"),
    )
    return merged.select(*keys, value, "start", "end", "rows").unionByName(closed)
