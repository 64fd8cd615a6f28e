"""Contract checks of report and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.functions.parse import (
    ROOT,
    WHITESPACE,
    get,
    is_blank,
    is_timestamp,
    kind_of,
    once,
    with_json,
    with_sections,
)
from vigil.operators.ordered import numbered
from vigil.operators.tail import tail_rows
from vigil.schema import EVENT_MODES, EVENT_TYPES, HEALTH_VALUES, REQUIRED_KEYS, SCHEMA_VERSION
from vigil.sources.spool import LINE_ORDER, block_group


def shown(value: str) -> str:
    """SQL: a JSON field as messages show it: quoted text, None, True, False or plain."""
    kind, text = kind_of(value), get(value)
    escaped = f"replace({text}, '\\\\', '\\\\\\\\')"
    single = f"concat('\\'', replace({escaped}, '\\'', '\\\\\\''), '\\'')"
    double = f"concat('\"', {escaped}, '\"')"
    quoted = (
        f"CASE WHEN contains({text}, '\\'') AND NOT contains({text}, '\"')"
        f" THEN {double} ELSE {single} END"
    )
    return (
        f"CASE WHEN coalesce({kind}, 'VOID') = 'VOID' THEN 'None' WHEN {kind} = 'STRING' THEN {quoted}"
        f" WHEN {kind} = 'BOOLEAN' THEN initcap({text}) ELSE to_json({value}) END"
    )


def _when_bad(check: str, message: str) -> str:
    """SQL: the message where a check fails or cannot be decided."""
    return f"CASE WHEN NOT coalesce({check}, false) THEN {message} END"


def _is_string(value: str, check: str) -> str:
    return f"{kind_of(value)} = 'STRING' AND {check}"


def _root_type(obj: str) -> str:
    kind = kind_of(f"try_variant_get({obj}, '{ROOT}', 'variant')")
    return (
        f"CASE WHEN {kind} = 'VOID' THEN 'NoneType' WHEN {kind} = 'STRING' THEN 'str'"
        f" WHEN {kind} = 'BOOLEAN' THEN 'bool' WHEN {kind} = 'BIGINT' THEN 'int'"
        f" WHEN startswith({kind}, 'ARRAY') THEN 'list' ELSE 'float' END"
    )


def _is_object(line: str) -> str:
    """SQL: whether a line known to be JSON holds an object."""
    return f"startswith(btrim({line}, ' \\t\\r\\n'), '{{')"


CHECKED_SECTIONS = ("assessment", "identity", "meta", "timing")


def report_errors(line: str = "line", obj: str = "_obj") -> Column:
    """All contract violations of one line, in order; empty when it is valid.

    ``obj`` is the line's JSON value of any type, or null if it is no JSON; its
    sections must have been added.
    """
    # a section that is an object has been found already
    absent = ", ".join(
        f"CASE WHEN _{key} IS NULL AND try_variant_get({obj}, '{ROOT}.{key}', 'variant') IS NULL"
        f" THEN '{key}' END"
        for key in REQUIRED_KEYS
    )
    missing = f"array_compact(array({absent}))"
    health, version = "_assessment.health", "_meta.schema_version"
    emitted, seq, node = "_timing.emitted_at", "_timing.seq", "_identity.node_id"
    allowed = ", ".join(f"'{h}'" for h in HEALTH_VALUES)
    listed = ", ".join(f"\\'{h}\\'" for h in HEALTH_VALUES)
    checks = [
        _when_bad(
            _is_string(health, f"{get(health)} IN ({allowed})"),
            f"concat('assessment.health must be one of [{listed}], got ', {shown(health)})",
        ),
        _when_bad(
            f"{get('_assessment.reasons', 'array<variant>')} IS NOT NULL",
            "'assessment.reasons must be an array'",
        ),
        _when_bad(
            _is_string(version, f"{get(version)} = '{SCHEMA_VERSION}'"),
            f"concat('meta.schema_version must be \\'{SCHEMA_VERSION}\\', got ', {shown(version)})",
        ),
        _when_bad(
            _is_string(emitted, "_emitted_ok"),
            f"concat('timing.emitted_at is not a valid RFC3339 timestamp: ', {shown(emitted)})",
        ),
        _when_bad(
            f"{kind_of(seq)} = 'BIGINT' AND {get(seq, 'bigint')} >= 1",
            f"concat('timing.seq must be an integer >= 1, got ', {shown(seq)})",
        ),
        _when_bad(
            _is_string(node, f"btrim({get(node)}, '{WHITESPACE}') <> ''"),
            "'identity.node_id must be a non-empty string'",
        ),
        _when_bad("_signals IS NOT NULL", "'signals must be an object'"),
    ]
    return F.expr(
        f"CASE WHEN {obj} IS NULL THEN array('invalid JSON')"
        f" WHEN NOT {_is_object(line)}"
        f" THEN array(concat('expected JSON object, got ', {_root_type(obj)}))"
        f" WHEN size({missing}) > 0 THEN array(concat("
        f"'missing required keys: [\\'', array_join({missing}, '\\', \\''), '\\']'))"
        f" ELSE array_compact(array({', '.join(checks)})) END"
    )


def validate_lines(lines: DataFrame) -> DataFrame:
    """Add ``errors`` and ``is_valid`` to non-blank report lines."""
    kept = lines.filter(~is_blank(F.col("line")))
    parsed = with_sections(with_json(kept, F.col("line"), "_obj"), "_obj", CHECKED_SECTIONS)
    stamped = parsed.select(
        "*",
        F.expr(f"try_variant_get(_obj, '{ROOT}.signals', 'struct<>') AS _signals"),
        is_timestamp(F.expr(get("_timing.emitted_at"))).alias("_emitted_ok"),
    )
    checked = once(stamped, errors=report_errors())
    return checked.select(*lines.columns, "errors", (F.size("errors") == 0).alias("is_valid"))


def validate_tail(lines: DataFrame, n: int = 200) -> DataFrame:
    """Check the last ``n`` non-blank lines of each file (all for ``n`` = 0).

    ``line_no`` counts the checked lines of a file from 1.
    """
    kept = lines.filter(~is_blank(F.col("line")))
    if n <= 0:
        tail = numbered(kept, ["file_path"], ["line_id"], "block_start", "line_no")
    else:
        tail = tail_rows(kept, n, ["file_path"], LINE_ORDER, block_group(kept))
        size = "max(tail_rank) OVER (PARTITION BY file_path)"
        tail = tail.withColumn("line_no", F.expr(f"CAST({size} - tail_rank + 1 AS BIGINT)"))
        tail = tail.drop("tail_rank")
    return validate_lines(tail)


def validation_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("error_count"),
    )


def validation_errors(checked: DataFrame) -> DataFrame:
    """One row per violation."""
    rest = [c for c in checked.columns if c not in ("errors", "is_valid", "line")]
    return checked.select(*rest, F.explode("errors").alias("message"))


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid lines as two tables over the same check."""
    return checked.filter("is_valid"), checked.filter(~F.col("is_valid"))


# Smallest allowed integer per event field.
EVENT_MINIMUMS = {
    "seq": 1,
    "interval_s": 1,
    "tick_elapsed_ms": 0,
    "collect_elapsed_ms": 0,
    "build_elapsed_ms": 0,
    "emit_elapsed_ms": 0,
    "sleep_ms": 0,
    "reports_emitted": 0,
    "spool_rotate_count": 1,
    "prior_size_bytes": 0,
    "bytes": 0,
}
EVENT_STRINGS = [
    "collector", "error_type", "message", "mode", "node_id", "rotated_to", "spool_path",
]


EVENT_FIELDS = [
    "agent_version", "event_type", "utc_now", "mode", "overrun", "spool_max_bytes",
    *[name for name in EVENT_STRINGS if name != "mode"],
    *EVENT_MINIMUMS,
]


def event_errors(line: str = "line", obj: str = "_obj") -> Column:
    """Violations of the event contract; ``_event`` holds the line's untyped fields."""
    def at(name: str) -> str:
        return f"_event.{name}"

    def unless(name: str, check: str, message: str) -> str:
        return (
            f"CASE WHEN {at(name)} IS NOT NULL AND NOT coalesce({check}, false) THEN {message} END"
        )

    def text_in(name: str, values: list[str]) -> str:
        listed = ", ".join(f"'{v}'" for v in values)
        return _is_string(at(name), f"{get(at(name))} IN ({listed})")

    checks = [
        f"CASE WHEN {at(name)} IS NULL THEN 'missing required key: {name}' END"
        for name in ("agent_version", "event_type", "utc_now")
    ]
    checks += [
        unless(
            "agent_version",
            _is_string(at("agent_version"), f"{get(at('agent_version'))} <> ''"),
            "'agent_version must be non-empty'",
        ),
        unless(
            "event_type",
            text_in("event_type", EVENT_TYPES),
            f"concat('unknown event_type: ', {shown(at('event_type'))})",
        ),
        unless(
            "utc_now",
            _is_string(at("utc_now"), "_utc_ok"),
            f"concat('utc_now is not a timestamp: ', {shown(at('utc_now'))})",
        ),
        unless(
            "mode",
            f"{kind_of(at('mode'))} <> 'STRING' OR {text_in('mode', EVENT_MODES)}",
            f"concat('unknown mode: ', {shown(at('mode'))})",
        ),
        unless("overrun", f"{kind_of(at('overrun'))} = 'BOOLEAN'", "'overrun must be a boolean'"),
        unless(
            "spool_max_bytes",
            f"{kind_of(at('spool_max_bytes'))} IN ('BIGINT', 'VOID')",
            "'spool_max_bytes must be an integer or null'",
        ),
    ]
    checks += [
        unless(name, f"{kind_of(at(name))} = 'STRING'", f"'{name} must be a string'")
        for name in EVENT_STRINGS
    ]
    checks += [
        unless(
            name,
            f"{kind_of(at(name))} = 'BIGINT' AND {get(at(name), 'bigint')} >= {least}",
            f"'{name} must be an integer >= {least}'",
        )
        for name, least in EVENT_MINIMUMS.items()
    ]
    return F.expr(
        f"CASE WHEN {obj} IS NULL THEN array('invalid JSON')"
        f" WHEN NOT {_is_object(line)} THEN array('expected JSON object')"
        f" ELSE array_compact(array({', '.join(checks)})) END"
    )


def validate_events(lines: DataFrame) -> DataFrame:
    """Add ``errors`` and ``is_valid`` to non-blank event lines."""
    kept = lines.filter(~is_blank(F.col("line")))
    fields = ", ".join(f"{name}: variant" for name in EVENT_FIELDS)
    parsed = with_json(kept, F.col("line"), "_obj")
    parsed = once(parsed, _event=F.expr(f"try_variant_get(_obj, '{ROOT}', 'struct<{fields}>')"))
    stamped = parsed.withColumn("_utc_ok", is_timestamp(F.expr(get("_event.utc_now"))))
    checked = once(stamped, errors=event_errors())
    return checked.select(*lines.columns, "errors", (F.size("errors") == 0).alias("is_valid"))
