"""The agent's event log: one sparse JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.schema import EVENT_SCHEMA, EVENT_TYPES
from vigil.sources.spool import read_lines


def parse_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """Typed columns of event lines; lines of an unknown event type are dropped."""
    event = F.from_json(F.col(column), EVENT_SCHEMA)
    rest = [c for c in lines.columns if c != column]
    return known_events(lines.select(*rest, event.alias("event")).select(*rest, "event.*"))


def known_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(EVENT_TYPES))


def read_events(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    return parse_events(read_lines(spark, paths, glob))
