"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; all but the last return the columns of ``documents``. ``run`` applies them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import bpe, common, decontaminate, minhash_dedup, suffix_dedup, toxicity
from vigil.llm.queries import importable


def hand_over(spark: SparkSession, rows: int) -> None:
    """Rows per batch that stages hand to Python from here on.

    A batch is in memory several times over, so most stages take small ones; what repeats within a
    batch is settled before the shuffle, so the search for repeats takes large ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    importable(spark)
    hand_over(spark, 1000)
    labels = common.read_table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.where("tox_score < 0.5").select("doc_id", "text", "lang", "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates: five-word shingles, similarity 0.8."""
    importable(spark)
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier; n_chars is counted anew."""
    importable(spark)
    hand_over(spark, 10_000)
    return suffix_dedup.with_kept_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no region matches a benchmark item."""
    importable(spark)
    hand_over(spark, 1000)
    return decontaminate.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and the digests of ids and decoded text."""
    importable(spark)
    hand_over(spark, 1000)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# training and the search for near-duplicates are beyond SQL; tests/llm compares the stages with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return docs
