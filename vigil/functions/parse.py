"""Lenient reading of JSON lines into typed columns.

A line is parsed once into a VARIANT. Typed columns are cut out of it with
``try_variant_get``, so a field of the wrong type becomes null instead of
failing the row, and a line that is no JSON object becomes a null variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigil.schema import SIGNALS

# Fixed value: the characters stripped from both ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The fields read from each section of a report.
SECTIONS = {
    "assessment": ["health", "reasons"],
    "identity": ["node_id", "boot_id"],
    "meta": ["agent_version", "schema_version", "threshold_profile", "thresholds_hash"],
    "signals": list(SIGNALS),
    "timing": ["emitted_at", "seq"],
}

# ISO 8601 calendar dates and date-times in extended form.
_ISO = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)

# The other forms: basic dates, week dates, any one separator, times cut short, offsets of any precision.
_ISO_PARTS = (
    "year date_dash month day week_dash week weekday hour time_colon minute second fraction"
    " offset sign offset_hour offset_colon offset_minute offset_second"
).split()
_ISO_OTHER = (
    r"(?s)^(?!0000)(\d{4})(?:(-?)(\d{2})\2(\d{2})|(-?)W(\d{2})(?:\5([1-7]))?)"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\9(\d{2})(?:[.,](\d+|(?=[Z+-])))?)?)?"
    r"(Z|([+-])(\d{2})(?:(:?)(\d{2})(?:\16(\d{2}))?)?)?)?$"
)


def strip(line: Column) -> Column:
    plain = F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}"))
    return F.when(plain, line).otherwise(F.btrim(line, F.lit(WHITESPACE)))


def is_blank(line: Column) -> Column:
    return ~F.startswith(line, F.lit("{")) & (F.btrim(line, F.lit(WHITESPACE)) == "")


def once(table: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions are worked out exactly once per row.

    A plain column is copied into every filter that names it, which for parsed
    JSON repeats the parsing. A generated column cannot be copied.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return table.select("*", F.inline(F.array(row)))


# A parsed line stays the only element of the array it was parsed in: cutting a
# whole object out of a VARIANT costs as much as parsing it.
ROOT = "$[0]"


def with_json(table: DataFrame, text: Column, name: str = "obj") -> DataFrame:
    """Add the VARIANT of a text holding exactly one JSON value, else null; read it from ROOT.

    The parser ignores what follows the first value, so the text is parsed as
    the only element of an array. A text that itself closes that array is told
    apart by parsing it as a member of an object too, which it cannot close;
    an object can only do so with a bracket after its closing brace.
    """
    marks = ["}]", "} ", "}\\t", "}\\r", "}\\n"]
    may_close = " OR ".join(f"contains(_text, '{mark}')" for mark in marks)
    parsed = table.withColumn("_text", text).selectExpr(
        "*",
        "try_parse_json('[' || _text || ']') AS _boxed",
        f"CASE WHEN NOT startswith(_text, '{{') OR {may_close}"
        " THEN try_parse_json('{\"m\":' || _text || '}') IS NULL ELSE false END AS _closes",
    )
    alone = "try_variant_get(_boxed, '$[1]', 'variant') IS NULL AND NOT _closes"
    value = F.expr(
        f"CASE WHEN {alone} AND _text <> '' THEN _boxed END"
    )
    return once(parsed, **{name: value}).drop("_text", "_boxed", "_closes")


def with_object(table: DataFrame, line: str = "line", name: str = "obj") -> DataFrame:
    """Add the VARIANT of a line holding one JSON object; null if blank, broken or no object."""
    text = strip(F.make_valid_utf8(line))
    return with_json(table, F.when(F.startswith(text, F.lit("{")), text), name)


def with_sections(table: DataFrame, obj: str = "obj", only: tuple[str, ...] = ()) -> DataFrame:
    """Add the report's sections as structs of untyped fields (``_assessment`` …).

    A section is looked up once, however many of its fields are read. One that
    is absent or no object is null.
    """
    found = {}
    for section in only or tuple(SECTIONS):
        fields = ", ".join(f"{name}: variant" for name in SECTIONS[section])
        kind = f"struct<{fields}>"
        found[f"_{section}"] = F.expr(f"try_variant_get({obj}, '{ROOT}.{section}', '{kind}')")
    return once(table, **found)


def kind_of(value: str) -> str:
    """SQL: JSON type name of a field (BIGINT, STRING, VOID …); null when absent."""
    return f"schema_of_variant({value})"


def get(value: str, kind: str = "string") -> str:
    """SQL: a field in the given type; null when it cannot be read so."""
    return f"try_variant_get({value}, '$', '{kind}')"


def _is_numeric(value: str) -> str:
    """SQL: BIGINT, DECIMAL(…), DOUBLE or FLOAT, told by the first letters."""
    return f"left({kind_of(value)}, 3) IN ('BIG', 'DEC', 'DOU', 'FLO')"


def number(value: str, kind: str) -> str:
    """SQL: a field that is a JSON number; strings and booleans give null."""
    return f"CASE WHEN {_is_numeric(value)} THEN {get(value, kind)} END"


def boolean(value: str) -> str:
    return f"CASE WHEN {kind_of(value)} = 'BOOLEAN' THEN {get(value, 'boolean')} END"


def coerce_int(value: str) -> str:
    """SQL: integer reading of any scalar: 3.9 -> 3, "5" -> 5, true -> 1, else null."""
    return get(value, "bigint")


def truthy(value: str) -> str:
    """SQL: a field as text; null if absent, null, empty, zero or false."""
    text = get(value)
    return (
        f"CASE WHEN {text} = '' THEN NULL WHEN {kind_of(value)} = 'STRING' THEN {text}"
        f" WHEN {text} = 'false' OR try_cast({text} AS DOUBLE) = 0 THEN NULL ELSE {text} END"
    )


def reasons(value: str) -> str:
    """SQL: reason tags as text; anything but an array gives the empty array."""
    return f"coalesce({get(value, 'array<string>')}, CAST(array() AS ARRAY<STRING>))"


def is_timestamp(text: Column) -> Column:
    return F.coalesce(parse_timestamp(text).isNotNull(), F.lit(False))


def parse_timestamp(text: Column) -> Column:
    """Instant of an ISO 8601 text; no offset means UTC, unreadable gives null.

    Calendar and week dates in extended and basic form, with any one character before the time. Only texts that
    the usual form does not settle are taken apart.
    """
    plain = F.translate(text, ",", ".")
    usual = F.when(text.rlike(_ISO), plain.try_cast("timestamp"))
    return F.coalesce(usual, F.when(text.rlike(_ISO_OTHER), _from_parts(text)))


def _from_parts(text: Column) -> Column:
    """Instant of a text that matches ``_ISO_OTHER``; a part out of its range gives null."""
    part = {name: F.regexp_extract(text, _ISO_OTHER, i) for i, name in enumerate(_ISO_PARTS, 1)}

    def number(name: str, absent: int = 0) -> Column:
        return F.when(part[name] == "", F.lit(absent)).otherwise(part[name].try_cast("int"))

    # the week of January 4 is the first, that of December 28 the last
    first = F.date_trunc("week", F.concat(part["year"], F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
    weeks = F.weekofyear(F.concat(part["year"], F.lit("-12-28")).try_cast("date"))
    days = (number("week") - 1) * 7 + number("weekday", 1) - 1
    by_week = F.when(number("week").between(1, weeks), F.date_add(first, days).cast("string"))
    by_month = F.concat_ws("-", part["year"], part["month"], part["day"])
    date = F.when(part["week"] == "", by_month).otherwise(by_week)
    time = F.concat_ws(":", *[F.lpad(part[name], 2, "0") for name in ("hour", "minute", "second")])
    local = F.concat(date, F.lit("T"), time, F.lit("."), F.rpad(part["fraction"], 6, "0"), F.lit("Z"))
    ahead = number("offset_hour") * 3600 + number("offset_minute") * 60 + number("offset_second")
    ahead = F.when(part["sign"] == "-", -ahead).otherwise(ahead)
    micros = F.unix_micros(local.try_cast("timestamp")) - ahead.cast("bigint") * 1_000_000
    return F.when(F.abs(ahead) < 86_400, F.timestamp_micros(micros))


def report_columns() -> list[Column]:
    """Flat typed columns of one report, from its sections."""
    named = {
        "node_id_raw": truthy("_identity.node_id"),
        "boot_id": get("_identity.boot_id"),
        "health": get("_assessment.health"),
        "reasons": reasons("_assessment.reasons"),
        "emitted_at": get("_timing.emitted_at"),
        "seq": coerce_int("_timing.seq"),
    }
    for name, kind in SIGNALS.items():
        value = f"_signals.{name}"
        named[name] = boolean(value) if kind == "boolean" else number(value, kind)
    for name in SECTIONS["meta"]:
        named[name] = get(f"_meta.{name}")
    return [F.expr(f"{text} AS {name}") for name, text in named.items()]


def has_status_fields() -> Column:
    """True when node id, health and emission time are truthy and seq is present."""
    seq = kind_of("_timing.seq")
    needed = [
        f"({truthy(value)}) IS NOT NULL"
        for value in ("_identity.node_id", "_assessment.health", "_timing.emitted_at")
    ]
    return F.expr(f"{' AND '.join(needed)} AND {seq} IS NOT NULL AND {seq} <> 'VOID'")
