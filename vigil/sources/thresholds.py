"""Threshold settings from layers: defaults, then file, then environment.

Layer rows are ``(profile, layer, section, key, value)`` with ``layer`` one of
``file`` and ``env``. Of several rows for one key of a layer the one of the
greatest ``position`` counts (a column of its own, if there is one), among
equals the one whose value sorts last. File values are JSON text; environment values are plain
text that counts only if it can be read as the key's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigil.functions.health import DEFAULT_THRESHOLDS
from vigil.functions.parse import ROOT, strip, with_json

# settings by section, with their default as JSON text
DEFAULT_SETTINGS = {
    **{tuple(name.split("_", 1)): repr(value) for name, value in DEFAULT_THRESHOLDS.items()},
    ("evaluation", "profile_name"): '"default"',
}
# a number as text; Spark's cast would take type suffixes too
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SECTIONS = ["cpu", "disk", "evaluation", "mem"]


def _quoted(text):
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(profile, document): the JSON files of a folder, named after them; null where a file is not UTF-8.

    Spark passes over files of no bytes, and those whose names begin with ``_`` or ``.``: they give no profile.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    text = F.col("content").cast("string")
    return files.select(
        F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("profile"),
        F.when(F.is_valid_utf8(text), text).alias("document"),
    )


def document_layers(documents: DataFrame) -> DataFrame:
    """``file`` layer rows of JSON documents (profile, document), one per key of a known section.

    A document that is null, broken or no object gives one row without a section, so its profile
    has all defaults; a section that is no object counts as absent. Of repeated members the last
    one counts. Values are JSON text: whole numbers as they stand, others as doubles.
    """
    known = ", ".join(f"'{s}', try_variant_get(obj, '{ROOT}.{s}', 'variant')" for s in SECTIONS)
    parsed = with_json(documents.select("profile", "document"), strip(F.col("document")))
    sections = parsed.select("profile", F.expr(f"stack({len(SECTIONS)}, {known}) AS (section, members)"))
    is_object = F.expr("startswith(schema_of_variant(members), 'OBJECT')")
    sections = sections.withColumn("members", F.when(is_object, F.col("members")))
    rows = sections.lateralJoin(
        documents.sparkSession.tvf.variant_explode_outer(F.col("members").outer())
    )
    kind = F.expr("schema_of_variant(value)")
    text = (
        F.when(kind == "VOID", F.lit("null"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.expr("CAST(try_variant_get(value, '$', 'double') AS STRING)"))
        .otherwise(F.to_json("value"))
    )
    given = F.col("key").isNotNull()
    return rows.select(
        "profile",
        F.lit("file").alias("layer"),
        F.when(given, F.col("section")).alias("section"),
        "key",
        F.when(given, text).alias("value"),
    ).distinct()


def resolve_layers(layers: DataFrame) -> DataFrame:
    """Winning value and its source per ``(profile, section, key)``.

    Every profile that occurs in ``layers`` gets all default settings. Keys the
    defaults do not know survive in known sections; unknown sections are
    dropped. A source is ``env`` as soon as the variable is set, even if its
    value could not be read, and ``file`` if the file differs from the default.
    """
    defaults = F.array(
        *[
            F.struct(
                F.lit("default").alias("layer"),
                F.lit(section).alias("section"),
                F.lit(key).alias("key"),
                F.lit(value).alias("value"),
            )
            for (section, key), value in DEFAULT_SETTINGS.items()
        ]
    )
    base = layers.select("profile").distinct().select("profile", F.inline(defaults))
    given = layers.filter(F.col("section").isin(SECTIONS)).select(
        "profile", "layer", "section", "key", "value", position_of(layers).alias("position")
    )
    known_env = F.struct("section", "key").isin(
        *[F.struct(F.lit(s), F.lit(k)) for s, k in DEFAULT_SETTINGS]
    )
    given = given.filter((F.col("layer") == "file") | ((F.col("layer") == "env") & known_env))
    name = F.col("section") == "evaluation"
    env_value = F.when(name, _quoted(F.col("value"))).otherwise(
        F.when(F.col("value").rlike(NUMBER), F.col("value").try_cast("double").cast("string"))
    )
    text = F.when(F.col("layer") == "env", env_value).otherwise(F.col("value"))
    rank = F.when(F.col("layer") == "env", 2).when(F.col("layer") == "file", 1).otherwise(0)
    base = base.withColumn("position", F.lit(0).cast("bigint"))
    rows = base.unionByName(given).withColumn("text", text).withColumn("rank", rank)
    later = F.struct("position", "text")
    env_set = F.bool_or(F.col("layer") == "env")
    file_text = F.max(F.when(F.col("layer") == "file", later))["text"]
    default_text = F.max(F.when(F.col("layer") == "default", F.col("text")))
    changed = F.when(
        file_text.try_cast("double").isNotNull() & default_text.try_cast("double").isNotNull(),
        file_text.try_cast("double") != default_text.try_cast("double"),
    ).otherwise(file_text.isNotNull() & ~file_text.eqNullSafe(default_text))
    return rows.groupBy("profile", "section", "key").agg(
        F.max(F.when(F.col("text").isNotNull(), F.struct("rank", "position", "text")))["text"].alias("value"),
        F.when(env_set, "env").when(changed, "file").otherwise("default").alias("source"),
    )


def position_of(layers: DataFrame) -> Column:
    return F.col("position").cast("bigint") if "position" in layers.columns else F.lit(0).cast("bigint")


def thresholds_table(resolved: DataFrame) -> DataFrame:
    """One row per profile: the six limits, the profile's name and its hash."""
    def limit(section: str, key: str):
        chosen = (F.col("section") == section) & (F.col("key") == key)
        return F.max(F.when(chosen, F.col("value").try_cast("double")))

    limits = [
        limit(*name.split("_", 1)).alias(name) for name in DEFAULT_THRESHOLDS
    ]
    # one entry per setting, so the array is as small as the configuration itself
    entries = F.array_sort(F.collect_list(F.struct("section", "key", "value")))
    wide = resolved.groupBy("profile").agg(
        *limits,
        F.max(
            F.when(
                (F.col("section") == "evaluation") & (F.col("key") == "profile_name"),
                F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"),
            )
        ).alias("profile_name"),
        entries.alias("entries"),
    )
    def section_json(name: str):
        pairs = F.transform(
            F.filter("entries", lambda e: e["section"] == name),
            lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]),
        )
        return F.concat(F.lit(f'"{name}":{{'), F.array_join(pairs, ","), F.lit("}"))

    sections = F.concat_ws(",", *[section_json(name) for name in SECTIONS])
    document = F.concat(F.lit("{"), sections, F.lit("}"))
    digest = F.substring(F.sha2(document, 256), 1, 16)
    return wide.withColumn("thresholds_hash", digest).drop("entries")
