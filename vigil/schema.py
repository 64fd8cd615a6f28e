"""Column vocabulary, schemas and fixed contract values."""

from __future__ import annotations

# Fixed values of the report contract.
HEALTH_VALUES = ["DEGRADED", "OK", "UNHEALTHY"]
REQUIRED_KEYS = ["assessment", "identity", "meta", "signals", "timing"]
SCHEMA_VERSION = "1"

# Fixed values of the event contract.
EVENT_TYPES = [
    "agent_shutdown",
    "agent_start",
    "agent_tick",
    "agent_tick_metrics",
    "collector_failed",
    "health_report_emitted",
    "spool_rotated",
    "spool_write_failed",
]
EVENT_MODES = ["oneshot", "run"]

# Collectors in run order; the flag says whether a failure degrades the node.
COLLECTORS = {
    "identity": True,
    "heartbeat": True,
    "cpu": True,
    "memory": True,
    "disk": True,
    "network": False,
}

# Signal columns and their types. A null signal means the collector gave nothing.
SIGNALS = {
    "heartbeat_ok": "boolean",
    "loadavg_1m": "double",
    "loadavg_5m": "double",
    "loadavg_15m": "double",
    "cpu_count_logical": "int",
    "mem_total_bytes": "bigint",
    "mem_available_bytes": "bigint",
    "disk_total_bytes": "bigint",
    "disk_used_bytes": "bigint",
    "disk_free_bytes": "bigint",
    "net_rx_bytes_total": "bigint",
    "net_tx_bytes_total": "bigint",
    "net_active_tcp_connections": "bigint",
}

# One event line of the agent log; every field may be absent.
EVENT_SCHEMA = (
    "event_type string, agent_version string, utc_now string, mode string, "
    "collector string, error_type string, message string, "
    "seq bigint, node_id string, interval_s bigint, "
    "tick_elapsed_ms bigint, collect_elapsed_ms bigint, build_elapsed_ms bigint, "
    "emit_elapsed_ms bigint, sleep_ms bigint, overrun boolean, reports_emitted bigint, "
    "skip_emit boolean, tick_duration_ms bigint, sleep_drift_ms bigint, "
    "collector_total_ms bigint, slowest_collector_name string, slowest_collector_ms bigint, "
    "spool_path string, spool_max_bytes bigint, spool_rotate_count bigint, "
    "rotated_to string, prior_size_bytes bigint, bytes bigint"
)
