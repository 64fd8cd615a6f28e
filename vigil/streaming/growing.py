"""Spools that grow: what was appended since the last run is read, and nothing twice.

The state is a log of offsets, a table per run with one row per file: how far its
lines have been read. A run first writes its plan (the ranges to read), then
hands their lines to the same batch bodies as ``stateful`` has, then marks the plan as done.
A run that was broken off is repeated with the plan it wrote, so the body
sees the same lines under the same number.

A file is known by its first line, not by its name: a spool that was rotated to another
name goes on where it was left, and the new file under the old
name begins at its start. A file that became shorter was written anew and begins
at its start too. Lines count from the moment they end in LF; what an agent is still
writing waits for the next run. Two files with the same first line are told apart by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigil.session import settle
from vigil.sources import ranges
from vigil.sources.spool import parse_lines, reports_of

# Longest part of a first line that is looked at.
HEAD = 1 << 16
# Runs for which a file that is not there is remembered.
REMEMBERED = 10
# Arrival of lines over several runs: a rotated file's rest comes before the new file under the old name.
ARRIVAL = ("spool", "batch_no", "turn", "block_start", "line_id")

Body = Callable[[DataFrame, int], None]


def with_heads(files: DataFrame) -> DataFrame:
    """Add the digest of every file's first line; files without a whole line are left out."""
    schema = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("head", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                opened, path = ranges.opened(row["file_path"])
                with opened.open_input_file(path) as source:
                    data = source.read(min(row["size"], HEAD))
                end = data.find(b"\n")
                if end >= 0 or len(data) == HEAD:
                    head = hashlib.sha256(data[: end if end >= 0 else HEAD]).hexdigest()
                    yield pa.RecordBatch.from_pylist([row | {"head": head}], schema=schema)

    return ranges.tasks(files, "file_path").mapInArrow(read, "file_path string, size long, head string")


def whole_lines(plan: DataFrame) -> DataFrame:
    """Replace ``size`` by the end of the last line that is complete, no further back than ``upto``."""
    names = plan.columns
    schema = pa.schema([(n, pa.string() if n in ("file_path", "head") else pa.int64()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = row["size"]
                opened, path = ranges.opened(row["file_path"])
                with opened.open_input_file(path) as source:
                    while end > row["upto"]:
                        start = max(row["upto"], end - ranges.FIRST)
                        source.seek(start)
                        at = source.read(end - start).rfind(b"\n")
                        if at >= 0:
                            end = start + at + 1
                            break
                        end = start
                yield pa.RecordBatch.from_pylist([row | {"size": end}], schema=schema)

    kinds = ", ".join(f"{n} {'string' if n in ('file_path', 'head') else 'long'}" for n in names)
    return ranges.tasks(plan, "file_path").mapInArrow(read, kinds)


class GrowingSpool:
    """A folder of spools, and the log of how far they were read."""

    def __init__(self, spark: SparkSession, folder: str, log: str, glob: str = "*.jsonl"):
        self.spark, self.folder, self.log, self.glob = spark, folder, log.rstrip("/"), glob

    def _runs(self, kind: str) -> list[int]:
        """Numbers of the runs whose plan is written, or done."""
        files, root = ranges.opened(f"{self.log}/{kind}")
        selector = ranges.pafs.FileSelector(root, allow_not_found=True)
        numbers = (int(f.base_name.removeprefix("run=")) for f in files.get_file_info(selector) if f.base_name.startswith("run="))
        return sorted(n for n in numbers if files.get_file_info(f"{root}/run={n}/_SUCCESS").type == ranges.pafs.FileType.File)

    def _plan(self, run: int) -> DataFrame:
        """Write what run ``run`` is to read: [upto, size) of every file."""
        found = settle(with_heads(ranges.list_files(self.spark, self.folder, self.glob)), "heads")
        if run == 0:
            known = found.withColumn("upto", F.lit(0).cast("long"))
            gone = known.limit(0).withColumn("missed", F.lit(0).cast("long"))
        else:
            before = self.spark.read.parquet(f"{self.log}/plans/run={run - 1}").select(
                "head", F.col("file_path").alias("old_path"), F.col("size").alias("old_size"), "missed"
            )
            same_name = Window.partitionBy("file_path").orderBy(F.desc(F.col("old_path") == F.col("file_path")), "old_path")
            joined = found.join(before, "head", "left").withColumn("place", F.row_number().over(same_name)).where("place = 1")
            fits = F.coalesce(F.col("old_size") <= F.col("size"), F.lit(False))
            known = joined.select("file_path", "size", "head", F.when(fits, F.col("old_size")).otherwise(0).cast("long").alias("upto"))
            gone = before.join(found.select("head"), "head", "left_anti").where(F.col("missed") < REMEMBERED)
            gone = gone.select(
                F.col("old_path").alias("file_path"), F.col("old_size").alias("size"), "head", F.col("old_size").alias("upto"),
                (F.col("missed") + 1).alias("missed"),
            )
        plan = whole_lines(known).withColumn("missed", F.lit(0).cast("long")).unionByName(gone)
        plan.write.mode("overwrite").parquet(f"{self.log}/plans/run={run}")
        return self.spark.read.parquet(f"{self.log}/plans/run={run}")

    def lines(self, run: int) -> DataFrame:
        """The lines that run ``run`` read, with their spool's name, the run, and their place."""
        plan = self.spark.read.parquet(f"{self.log}/plans/run={run}")
        zones = plan.select("file_path", "size", F.col("upto").alias("low"), F.col("size").alias("high"))
        lines = ranges.read_ranges(ranges.pieces_of(zones))
        name = F.element_at(F.split("file_path", "/"), -1)
        rotated = F.regexp_extract(name, r"\.(\d+)\.[^.]*$", 1)
        return lines.select(
            F.regexp_replace(name, r"(\.\d+)?\.[^.]*$", "").alias("spool"),
            F.lit(run).cast("long").alias("batch_no"),
            F.when(rotated != "", -rotated.cast("long")).otherwise(0).alias("turn"),
            *lines.columns,
        )

    def advance(self, body: Body) -> int:
        """One run over what is new; ``body`` gets its reports and its number. Returns the number."""
        planned, done = self._runs("plans"), self._runs("done")
        run = planned[-1] if planned and planned[-1] not in done else len(planned)
        if run not in planned:
            self._plan(run)
        body(reports_of(parse_lines(self.lines(run))), run)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.log}/done/run={run}")
        return run
