"""Appends to a spool folder that keep the order in which they were made.

Append k is the folder ``append=k`` below the spool, its number written with leading
zeros, its files numbered in the order of the rows. The order of file
paths is therefore the order of appends and of rows in them, which is what
``spool.ARRIVAL`` goes by. An append counts once its folder is marked as complete; number and
folder are taken in one step, and an append that finds its number taken tries the next.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.sources import spool
from vigil.sources.ranges import opened


def folder_of(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/append={number:010d}"


def numbers(path: str, complete: bool = True) -> list[int]:
    """Numbers of the appends made, in order."""
    files, root = opened(path)
    found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    taken = sorted(int(f.base_name.removeprefix("append=")) for f in found if f.base_name.startswith("append="))
    if not complete:
        return taken
    return [k for k in taken if files.get_file_info(folder_of(root, k) + "/_SUCCESS").type == pafs.FileType.File]


def append_reports(rows: DataFrame, path: str, order: Sequence[str], column: str = "line", number: int | None = None) -> int:
    """Append one line per row, in ``order``; returns the append's number.

    With ``number`` given, an append made before under it is replaced, so a
    repeated micro-batch leaves one copy.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).alias("value"))
    if number is not None:
        ordered.write.mode("overwrite").text(folder_of(path, number))
        return number
    taken = numbers(path, complete=False)
    number = taken[-1] + 1 if taken else 0
    while True:
        try:
            ordered.write.mode("errorifexists").text(folder_of(path, number))
            return number
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all complete appends; ``spool.ARRIVAL`` is the order in which they were appended."""
    return spool.read_lines(spark, [folder_of(path, k) for k in numbers(path)])


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """Reports of all complete appends; lines that do not parse are skipped."""
    return spool.reports_of(spool.parse_lines(read_lines(spark, path)))


def append_stream(rows: DataFrame, path: str, checkpoint: str, order: Sequence[str], column: str = "line"):
    """Writer that makes every micro-batch one append, under the batch's number."""

    def body(batch: DataFrame, batch_id: int) -> None:
        append_reports(batch, path, order, column, number=batch_id)

    return rows.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
