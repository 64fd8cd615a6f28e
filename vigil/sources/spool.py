"""JSONL spools as tables of physical lines and parsed reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigil.functions.parse import is_blank, report_columns, with_object, with_sections
from vigil.operators.tail import tail_rows

# Physical position of a line: file, then block start, then order inside the block.
LINE_ORDER = ("block_start", "line_id")
ARRIVAL = ("file_path", *LINE_ORDER)
LINES_SCHEMA = "file_path string, block_start bigint, line_id bigint, line string"

# Blocks of one file whose tails are cut together before the file's own cut.
BLOCKS_PER_GROUP = 64


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths (or path patterns) that match anything."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for path in paths:
        place = hadoop.Path(path)
        if place.getFileSystem(settings).globStatus(place):
            found.append(path)
    return found


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str | None = None,
    on_missing: str = "empty",
) -> DataFrame:
    """Physical lines of one or many spools with their position.

    Missing paths are left out, or all named in a ``FileNotFoundError`` with
    ``on_missing="error"``; with no path left the table is empty.
    """
    if on_missing not in ("empty", "error"):
        raise ValueError("on_missing must be 'empty' or 'error'")
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    wanted = [paths] if isinstance(paths, str) else list(paths)
    there = _present(spark, wanted)
    if on_missing == "error" and len(there) < len(wanted):
        raise FileNotFoundError(f"spool not found: {', '.join(p for p in wanted if p not in there)}")
    if not there:
        return spark.createDataFrame([], LINES_SCHEMA)
    raw = reader.text(there)
    # line_id must come straight from the scan: it follows the order of lines in a block
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").alias("line"),
    )


def block_group(lines: DataFrame) -> Column:
    """Neighbouring blocks of a file, so that a huge file is cut in many tasks."""
    spark = lines.sparkSession
    block = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    width = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(block) * BLOCKS_PER_GROUP
    return F.floor(F.col("block_start") / F.lit(width))


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` physical lines of every file; blank lines use up places too."""
    return tail_rows(
        lines, n, keys=["file_path"], order=LINE_ORDER, spread=block_group(lines)
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add the parsed object and say whether a line is blank or invalid."""
    blank = is_blank(F.make_valid_utf8("line"))
    return with_object(lines).withColumn("is_invalid", F.col("obj").isNull() & ~blank)


def reports_of(parsed: DataFrame, raw_seq: bool = False) -> DataFrame:
    """Typed reports of the lines that parsed; positions stay as arrival order.

    ``raw_seq`` adds seq as it stands in the line, which may be no whole number: as text and as JSON.
    """
    kept = parsed.filter(F.col("obj").isNotNull())
    position = [c for c in parsed.columns if c not in ("line", "obj", "is_invalid")]
    raw = [F.expr("cast(_timing.seq AS string) AS seq_text"), F.expr("to_json(_timing.seq) AS seq_json")] if raw_seq else []
    typed = with_sections(kept).select(*position, *report_columns(), *raw)
    return typed.withColumn("node_id", F.coalesce("node_id_raw", F.lit("unknown")))


def read_spool(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str | None = None,
    on_missing: str = "empty",
) -> DataFrame:
    """Every report of the spools; lines that do not parse are skipped."""
    return reports_of(parse_lines(read_lines(spark, paths, glob, on_missing)))


def tail_spool(
    spark: SparkSession,
    paths: str | Sequence[str],
    n: int,
    glob: str | None = None,
    on_missing: str = "empty",
) -> DataFrame:
    """The parsed tail of every file: lines, objects and invalid marks."""
    return parse_lines(tail_lines(read_lines(spark, paths, glob, on_missing), n))


def count_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> int:
    """Number of spool files, empty ones included."""
    try:
        files = spark.read.option("pathGlobFilter", glob).text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return 0
    return len(files.inputFiles())


def invalid_counts(parsed: DataFrame) -> DataFrame:
    """Lines, parsed reports and invalid lines per file."""
    return parsed.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("obj").alias("reports_parsed"),
        F.count_if("is_invalid").alias("reports_invalid"),
    )


def append_reports(reports: DataFrame, path: str, column: str = "line") -> None:
    """Append one JSON line per row to a spool folder, created when missing."""
    reports.select(column).write.mode("append").text(path)
