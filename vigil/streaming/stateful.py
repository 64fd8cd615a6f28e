"""Live per-node results that need memory between micro-batches.

The memory is a table in a folder every executor can reach, cut into buckets by
a hash of its keys. A batch reads the newest earlier version of the buckets
that it touches, and writes these buckets anew under its own number; all others stay as they
are. A batch repeated after a failure therefore reads what it read before and
writes the same result again. Inside a batch the ordinary batch operators run,
so a node with very many reports in one batch is cut or segmented like in batch mode
and never held by a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.operators.ordered import with_previous
from vigil.operators.summarize import summarize_by_node
from vigil.operators.tail import tail_rows
from vigil.session import settle
from vigil.sources.ranges import opened

BUCKETS = 64

Body = Callable[[DataFrame, int], None]


class Buckets:
    """A state table below ``folder``: ``bucket=b/batch=k`` is bucket b as batch k left it."""

    def __init__(self, folder: str, keys: Sequence[str], count: int = BUCKETS):
        self.folder, self.keys, self.count = folder.rstrip("/"), list(keys), count

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(0), *self.keys), F.lit(self.count)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows, at most ``count``."""
        return sorted(r["bucket"] for r in self.bucketed(rows).select("bucket").distinct().collect())

    def _versions(self, bucket: str) -> list[int]:
        files, root = opened(f"{self.folder}/{bucket}")
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("batch=")) for f in found if f.base_name.startswith("batch="))

    def before(self, spark: SparkSession, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The state ahead of batch ``batch_id``: all buckets, or the given ones; None if they hold nothing yet."""
        newest = []
        for bucket in range(self.count) if buckets is None else buckets:
            earlier = [k for k in self._versions(f"bucket={bucket}") if k < batch_id]
            if earlier:
                newest.append(f"{self.folder}/bucket={bucket}/batch={earlier[-1]}")
        return spark.read.parquet(*newest) if newest else None

    def write(self, state: DataFrame, batch_id: int) -> None:
        """Write the touched buckets under the batch's number, and drop versions that no batch can ask for any more."""
        rows = self.bucketed(state).withColumn("batch", F.lit(batch_id)).repartition("bucket")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "batch").parquet(self.folder)
        for bucket in range(self.count):
            versions = self._versions(f"bucket={bucket}")
            for old in [k for k in versions if k < batch_id][:-1]:
                files, root = opened(self.folder)
                files.delete_dir(f"{root}/bucket={bucket}/batch={old}")


def latest(spark: SparkSession, out_folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key over all batches written to ``out_folder``."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    rows = spark.read.parquet(out_folder).withColumn("_place", F.row_number().over(newest))
    return rows.where("_place = 1").drop("_place", "batch")


def upserts(out_folder: str) -> Body:
    """``foreachBatch`` body for update mode: the changed rows of batch b go to ``out_folder/batch=b``; read them with ``latest``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")

    return process


def node_summaries(
    state_folder: str,
    out_folder: str,
    n: int,
    order: Sequence[str],
    top_k: int | None = 5,
    keys: Sequence[str] = ("node_id",),
) -> Body:
    """``foreachBatch`` body: summaries of each node's last ``n`` reports so far.

    State is those tails. ``keys`` is what a tail belongs to, the node or its file. With the
    node, batch b writes the nodes of touched buckets to ``out_folder/batch=b``, to be read
    with ``latest``; otherwise a node may have tails in any bucket, and it writes all nodes.
    """
    state = Buckets(state_folder, keys)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = settle(tail_rows(batch, n, list(keys), order).drop("tail_rank"), "new-tails")
        touched = state.touched(new)
        if touched:
            before = state.before(spark, batch_id, touched)
            rows = new if before is None else before.unionByName(new)
            state.write(tail_rows(rows, n, list(keys), order).drop("tail_rank"), batch_id)
        tails = state.before(spark, batch_id + 1, touched if list(keys) == ["node_id"] else None)
        if tails is not None:
            summaries = summarize_by_node(tails, top_k, order)
            summaries.write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")

    return process


def health_changes(
    state_folder: str,
    out_folder: str,
    order: Sequence[str],
    segment: str,
) -> Body:
    """``foreachBatch`` body: one row per change of a node's health.

    State is the last health of each node. A node's first report is no change.
    The changes of batch b go to ``out_folder/batch=b``.
    """
    state = Buckets(state_folder, ["node_id"])

    def process(batch: DataFrame, batch_id: int) -> None:
        columns = list(dict.fromkeys(["node_id", *order, segment]))
        rows = batch.select(*columns, F.coalesce("health", F.lit("unknown")).alias("health"))
        newest = rows.groupBy("node_id").agg(F.max_by("health", F.struct(*order)).alias("last_health"))
        newest = settle(newest, "newest")
        rows = with_previous(rows, ["node_id"], order, segment, ["health"])
        touched = state.touched(newest)
        before = state.before(batch.sparkSession, batch_id, touched) if touched else None
        if before is not None:
            rows = rows.join(before, "node_id", "left").withColumn(
                "prev_health", F.coalesce("prev_health", "last_health")
            )
            newest = newest.unionByName(before.join(newest, "node_id", "left_anti"))
        changes = rows.filter(F.col("prev_health") != F.col("health")).select(
            *columns, "prev_health", "health"
        )
        changes.write.mode("overwrite").parquet(f"{out_folder}/batch={batch_id}")
        if touched:
            state.write(newest, batch_id)

    return process


def merged_sessions(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join sessions that overlap; one that begins where another ends is one of its own."""
    earlier = Window.partitionBy(*by).orderBy("session_start", "session_end")
    reach = F.max("session_end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("session_start") < reach, 0).otherwise(1)
    numbered = sessions.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        F.sum("reports").alias("reports"),
        F.sum("unhealthy").alias("unhealthy"),
    ).drop("_run")


class OutageSessions:
    """Sessions of reports that are not OK, per node, shown from their first report on.

    State is the sessions that can still grow. A session that ended ``late`` or longer
    before the newest report seen is closed when a batch touches its bucket, and a report
    that ends as early as that is late and left out. ``result`` has open and closed
    sessions: one appears with its first report, grows, and joins others as reports arrive.
    """

    def __init__(self, state_folder: str, gap: str = "6 hours", late: str = "1 hour", time: str = "emitted_ts"):
        self.state = Buckets(f"{state_folder}/sessions", ["node_id"])
        self.clock = Buckets(f"{state_folder}/clock", [], 1)
        self.closed, self.gap, self.late, self.time = f"{state_folder}/closed", gap, late, time

    def over(self, newest: int) -> Column:
        """Whether a session can no longer grow, the newest report being of ``newest`` microseconds."""
        return F.col("session_end") <= F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {self.late}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = self.clock.before(spark, batch_id)
        seen = None if clock is None else clock.first()["newest"]
        bad = batch.where(F.col("health") != "OK").select(
            "node_id",
            F.col(self.time).alias("session_start"),
            F.expr(f"{self.time} + INTERVAL {self.gap}").alias("session_end"),
            F.lit(1).cast("long").alias("reports"),
            (F.col("health") == "UNHEALTHY").cast("long").alias("unhealthy"),
        )
        if seen is not None:
            bad = bad.where(~self.over(seen))
        # days first: what is left of a busy node is a few sessions per day
        by_day = bad.withColumn("_day", F.to_date("session_start"))
        new = settle(merged_sessions(by_day, ["node_id", "_day"]).drop("_day"), "new-sessions")
        newest = batch.agg(F.max(F.unix_micros(self.time))).first()[0]
        newest = max((t for t in (seen, newest) if t is not None), default=None)
        touched = self.state.touched(new)
        if touched:
            before = self.state.before(spark, batch_id, touched)
            rows = new if before is None else before.where("not closed").select(*new.columns).unionByName(new)
            now = settle(merged_sessions(rows, ["node_id"]).withColumn("closed", self.over(newest)), "sessions")
            now.where("closed").write.mode("overwrite").parquet(f"{self.closed}/batch={batch_id}")
            self.state.write(now, batch_id)
        if newest is not None:
            self.clock.write(spark.createDataFrame([(newest,)], "newest long"), batch_id)

    def result(self, spark: SparkSession, batches: int) -> DataFrame:
        """All sessions after the first ``batches`` batches."""
        columns = "node_id", "session_start", "session_end", "reports", "unhealthy"
        state = self.state.before(spark, batches)
        if state is None:
            return spark.createDataFrame([], "node_id string, session_start timestamp, session_end timestamp, reports long, unhealthy long")
        closed = spark.read.parquet(self.closed).where(F.col("batch") < batches)
        return state.where("not closed").select(*columns).unionByName(closed.select(*columns))


def run_batches(rows: DataFrame, process: Body, checkpoint: str, mode: str = "append"):
    """Writer that hands every micro-batch to ``process``."""
    return rows.writeStream.outputMode(mode).foreachBatch(process).option("checkpointLocation", checkpoint)
