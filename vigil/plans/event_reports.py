"""Health reports derived from the ``events`` table (see FIXTURES.md, section 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.functions.health import evaluate, failure_reasons
from vigil.session import configure

ARRIVAL = ("emitted_at", "event_id")
SEGMENT = "segment"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def signals_of(events: DataFrame) -> DataFrame:
    """Signal readings of every event row, before any verdict. A pure projection."""
    base = events.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
        "CAST(ts AS TIMESTAMP) AS emitted_ts",
    )
    marked = base.selectExpr(
        "*",
        "NOT (event_type = 'signup' AND k % 10 = 0) AS cpu_ok",
        "NOT (event_type = 'error' AND k % 4 = 0) AS beat_ok",
    )
    return marked.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "k",
        "emitted_ts",
        "concat('node-', lpad(CAST(user_id % 20 AS STRING), 2, '0')) AS node_id",
        "concat('boot-', (dayofmonth(emitted_ts) - 1) div 10) AS boot_id",
        "concat(date_format(emitted_ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+00:00') AS emitted_at",
        "event_id + 1 AS seq",
        f"unix_micros(emitted_ts) div 3600000000 AS {SEGMENT}",
        "CASE WHEN beat_ok THEN true END AS heartbeat_ok",
        "CASE WHEN cpu_ok THEN value / 10 END AS loadavg_1m",
        "CASE WHEN cpu_ok THEN value / 20 END AS loadavg_5m",
        "CASE WHEN cpu_ok THEN value / 40 END AS loadavg_15m",
        "8 AS cpu_count_logical",
        "17179869100 AS mem_total_bytes",
        "(k + 1) * 171798691L AS mem_available_bytes",
        "500000000000 AS disk_total_bytes",
        "((event_id * 37) % 100 + 1) * 5000000000 AS disk_free_bytes",
        "array(named_struct('name', 'heartbeat', 'ok', beat_ok),"
        " named_struct('name', 'cpu', 'ok', cpu_ok),"
        " named_struct('name', 'network', 'ok', k % 3 <> 0)) AS outcomes",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(load(spark, sf_dir, "events"))


def reports_of(events: DataFrame, thresholds=None) -> DataFrame:
    return evaluate(signals_of(events), thresholds, failure_reasons(F.col("outcomes")))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their verdict under the default thresholds."""
    return reports_of(load(spark, sf_dir, "events"))
