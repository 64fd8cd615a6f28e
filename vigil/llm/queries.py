"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (
    bpe,
    common,
    decontaminate,
    hard_negatives,
    licenses,
    lm_scoring,
    merkle,
    minhash_dedup,
    piece_spans,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers of a session started elsewhere find this package.

    Where executors have other paths, ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def query(run: Query) -> Query:
    @functools.wraps(run)
    def started(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = started
    return started


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside fold 0 of 5."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return toxicity.score(docs, model).select(
        "doc_id",
        (common.fold(5) == 0).alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in every document."""
    return licenses.scan(common.read_table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packaged WARC records and read back."""
    packages = warc.archive(spark, common.read_table(spark, sf_dir, "pages"))
    return warc.read_back(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and their likeness."""
    return merkle.edited_pairs(common.read_table(spark, sf_dir, "documents"))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash_dedup.near_duplicates(common.read_table(spark, sf_dir, "documents"))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that start earlier."""
    return substring_dedup.deduplicate(common.read_table(spark, sf_dir, "documents"))


@query
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learned outside fold 2 of 7."""
    return lm_scoring.score(common.read_table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents that match a benchmark item within its edit budget."""
    docs, items = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")
    return decontaminate.find(docs, items)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every document's text, and of the text decoded."""
    import public_tokenizers

    docs, path = common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, with_ids=False).drop("ids")


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier."""
    return suffix_dedup.deduplicate(common.read_table(spark, sf_dir, "documents"))


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces, of their source spans, and of the text decoded."""
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents")
    return piece_spans.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one."""
    rows = common.read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.integers(F.col("embedding"), 256).alias("v"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, with corpus-wide counts of linked ids."""
    import public_tokenizers

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.summaries(common.read_table(spark, sf_dir, "documents"), *paths)
