"""Live sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.functions.health import evaluate
from vigil.sources.spool import parse_lines, reports_of


def stream_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Lines of spool files as they appear in a folder."""
    raw = spark.readStream.option("pathGlobFilter", glob).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("line"),
    )


def stream_reports(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Live parsed reports; lines that do not parse are skipped."""
    return reports_of(parse_lines(stream_lines(spark, path, glob)))


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_evaluate(signals: DataFrame, thresholds=None, failures=None) -> DataFrame:
    """Live verdicts: the batch projection applied to a stream."""
    return evaluate(signals, thresholds, failures)


def write_table_stream(rows: DataFrame, path: str, checkpoint: str):
    """Writer that appends rows to a Parquet folder exactly once."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )


def run_available(writer) -> None:
    """Process what is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
