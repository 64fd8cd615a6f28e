"""Spool files read by byte ranges: listings, bounded tails, and files written whole under given names.

Files are opened in tasks through Arrow's filesystems (local, HDFS, S3, GCS), so
a task reads just the bytes of its range. Files whose names begin with ``_``
or ``.`` are ordinary here, unlike for Spark's readers.

A line starts at the first byte of a file, after LF, and after CR without LF;
whether a byte starts a line is told by it and the byte before it, so any
range can be worked on alone. A range has the lines that start in it, and
the last of them is read to its end beyond the range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.session import settle

# Bytes of a range that one task reads at once, and of a tail's first try.
PIECE = 1 << 20
FIRST = 1 << 16
# How much further back a tail goes when it has too few lines yet.
FURTHER = 8
# Parts per shuffle partition over which written files are dealt.
FILE_PARTS = 8
LF, CR = 10, 13


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path in it."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def line_starts(data: bytes, before: int | None) -> np.ndarray:
    """Offsets in ``data`` at which a line starts; ``before`` is the byte before it, None at the start of a file."""
    codes = np.frombuffer(data, np.uint8)
    last = np.concatenate(([LF if before is None else before], codes[:-1])).astype(np.uint8)
    return np.flatnonzero((last == LF) | ((last == CR) & (codes != LF)))


def read_at(source, start: int, stop: int) -> tuple[bytes, int | None]:
    """Bytes of a range, and the byte before it."""
    begin = max(0, start - 1)
    source.seek(begin)
    data = source.read(stop - begin)
    return (data, None) if start == 0 else (data[1:], data[0])


def lines_of(source, start: int, stop: int, end: int, last: int | None = None) -> list[tuple[int, str]]:
    """(offset, text) of the lines that start in [start, stop) of a file of ``end`` bytes, the ``last`` of them if given."""
    data, before = read_at(source, start, stop)
    starts = line_starts(data, before)
    if last is not None:
        starts = starts[max(0, len(starts) - last) :]
    if not len(starts):
        return []
    while start + len(data) < end:
        more, _ = read_at(source, start + len(data), min(end, start + len(data) + FIRST))
        if not more:
            break
        following = line_starts(more, data[-1])
        if len(following):
            data += more[: following[0]]
            break
        data += more
    ends = [*starts[1:].tolist(), len(data)]
    texts = (data[a:b] for a, b in zip(starts.tolist(), ends, strict=True))
    return [(start + a, line_text(raw)) for a, raw in zip(starts.tolist(), texts, strict=True)]


def line_text(raw: bytes) -> str:
    for ending in (b"\r\n", b"\n", b"\r"):
        if raw.endswith(ending):
            raw = raw[: -len(ending)]
            break
    return raw.decode("utf-8", "replace")


def tasks(table: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out so that each is worked on by itself; the number of parts is given, or few rows would meet in one task."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(file_path, size) of files, and of the files of folders whose names match ``glob``; what is missing is left out.

    Folders are listed by tasks, one each.
    """
    schema = pa.schema([("file_path", pa.string()), ("size", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = opened(uri)
                told = files.get_file_info(path)
                if told.type == pafs.FileType.File:
                    found = [(uri, told.size)]
                elif told.type == pafs.FileType.Directory:
                    inside = files.get_file_info(pafs.FileSelector(path))
                    named = [f for f in inside if f.type == pafs.FileType.File and fnmatchcase(f.base_name, glob)]
                    found = [(f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in named]
                else:
                    found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=schema)

    wanted = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.createDataFrame([(p,) for p in wanted], "path string")
    return rows.mapInArrow(listed, "file_path string, size long")


def pieces_of(zones: DataFrame, piece: int = PIECE) -> DataFrame:
    """Ranges (file_path, size, start, stop) of at most ``piece`` bytes that make up [low, high) of every file."""
    cut = zones.where("high > low").withColumn("start", F.explode(F.sequence("low", F.col("high") - 1, F.lit(piece))))
    return cut.select("file_path", "size", "start", F.least(F.col("start") + piece, F.col("high")).alias("stop"))


def count_starts(pieces: DataFrame) -> DataFrame:
    """How many lines start in every range."""
    schema = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lines", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = opened(row["file_path"])
                with files.open_input_file(path) as source:
                    count = len(line_starts(*read_at(source, row["start"], row["stop"])))
                yield pa.RecordBatch.from_pylist([row | {"lines": count}], schema=schema)

    return tasks(pieces, "file_path", "start").mapInArrow(counted, "file_path string, size long, start long, stop long, lines long")


def read_ranges(pieces: DataFrame) -> DataFrame:
    """(file_path, block_start, line_id, line): the lines that start in every range, ``line_id`` being their offset in the file.

    A column ``last`` keeps the last so many lines of a range.
    """
    schema = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("line_id", pa.int64()), ("line", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = opened(row["file_path"])
                with files.open_input_file(path) as source:
                    found = lines_of(source, row["start"], row["stop"], row["size"], row["last"])
                if found:
                    at, texts = zip(*found, strict=True)
                    same = [[row[k]] * len(at) for k in ("file_path", "start")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((*same, at, texts), schema, strict=True)], schema=schema)

    wanted = pieces if "last" in pieces.columns else pieces.withColumn("last", F.lit(None).cast("long"))
    rows = tasks(wanted.select("file_path", "size", "start", "stop", "last"), "file_path", "start")
    return rows.mapInArrow(read, "file_path string, block_start long, line_id long, line string")


def tail_pieces(files: DataFrame, n: int, first: int = FIRST) -> DataFrame:
    """Ranges at the ends of files with their last ``n`` lines, and how many of its lines are wanted from each.

    Lines are counted from the end of a file backwards: ``first`` bytes, then, for the files with too few lines in them, up to
    ``FURTHER`` times as many, and so on. A range is counted once, and what lies before the last n lines is read up to
    ``FURTHER`` times their size at most, whatever the size of the file.
    """
    waiting = files.where("size > 0").select("file_path", "size", F.col("size").alias("high"), F.lit(0).cast("long").alias("seen"))
    counted: DataFrame | None = None
    reach = first
    while True:
        zones = waiting.withColumn("low", F.greatest(F.lit(0).cast("long"), F.col("size") - reach))
        now = settle(count_starts(pieces_of(zones)), "counted")
        counted = now if counted is None else counted.unionAll(now)
        sums = now.groupBy("file_path").agg(F.sum("lines").alias("more"))
        waiting = (
            zones.join(sums, "file_path")
            .select("file_path", "size", F.col("low").alias("high"), (F.col("seen") + F.col("more")).alias("seen"))
            .where((F.col("seen") < n) & (F.col("high") > 0))
        )
        waiting = settle(waiting, "waiting")
        if waiting.isEmpty():
            break
        reach *= FURTHER
    later = Window.partitionBy("file_path").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    after = counted.withColumn("after", F.coalesce(F.sum("lines").over(later), F.lit(0)))
    kept = after.where((F.col("after") < n) & (F.col("lines") > 0))
    return kept.select("file_path", "size", "start", "stop", F.least(F.col("lines"), n - F.col("after")).alias("last"))


def tail_lines(spark: SparkSession, paths: str | Sequence[str], n: int, glob: str = "*", first: int = FIRST) -> DataFrame:
    """The last ``n`` physical lines of every file, found from the ends of the files; blank lines use up places too.

    Columns as of ``spool.read_lines``; n of 0 or less gives no lines.
    """
    files = settle(list_files(spark, paths, glob), "files")
    return read_ranges(tail_pieces(files.limit(0) if n <= 0 else files, n, first))


def write_files(
    lines: DataFrame, folder: str, name: Column, order: Sequence[str], line: str = "line", ending_of_last: bool = True
) -> None:
    """One file per ``name`` with its lines in ``order``, replaced as a whole; the last line can be left without its end.

    A file appears under its name when it is complete, so a task that is run again does no harm. A file's lines
    go through one task as a stream.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        current, out = None, None

        def finish() -> None:
            if out is not None:
                out.write(b"\n" if ending_of_last else b"")
                out.close()
                files.move(f"{root}/{current}.part", f"{root}/{current}")

        for batch in batches:
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for file, rows in groupby(named, key=itemgetter(0)):
                text = "\n".join(row[1] for row in rows).encode()
                if file != current:
                    finish()
                    current, out = file, files.open_output_stream(f"{root}/{file}.part")
                else:
                    out.write(b"\n")
                out.write(text)
        finish()
        yield from ()

    rows = lines.select(name.alias("_file"), F.col(line).alias("_line"), *order)
    # many parts, as two files in one of them wait for each other
    parts = FILE_PARTS * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "_file").sortWithinPartitions("_file", *order).select("_file", "_line")
    dealt.mapInArrow(written, "nothing int").count()
