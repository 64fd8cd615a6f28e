"""Merkle tree over the paragraphs and sections of a text.

Leaves are pieces of at most 32 code points of a paragraph (a line); a
paragraph's digest is the SHA-256 of its leaves' digests, a section's that of
its paragraphs' and the root that of its sections'. A new section begins at a
paragraph whose digest begins with 0 or 1, so an inserted paragraph moves no
section bounds but its own. Equal roots mean equal texts; below differing roots, differing
branches lead to the edited pieces.

Everything is DataFrame expressions. A leaf digest is cut to 128 bits, all
others are whole.

Defined results: a null text is empty; an empty text is one paragraph without
leaves and has a fixed root; two texts without leaves have likeness 1, one
with and one without have likeness 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common

LEAF = 32


def tree(text: Column) -> Column:
    """Leaf digests by paragraph: array<array<string>>."""

    def leaves(paragraph: Column) -> Column:
        pieces = F.regexp_extract_all(paragraph, F.lit("(?s).{1,%d}" % LEAF), F.lit(0))
        return F.transform(pieces, lambda piece: F.left(F.sha2(piece, 256), F.lit(LEAF)))

    return F.transform(F.split(text, "\n"), leaves)


def paragraphs(leaves: Column) -> Column:
    """Digest of each paragraph."""
    return F.transform(leaves, lambda p: F.sha2(F.array_join(p, ""), 256))


def sections(digests: Column) -> Column:
    """Digest of each section, from the paragraphs' digests."""
    cut = F.split(F.regexp_replace(F.array_join(digests, " "), " ([01])", "\n$1"), "\n")
    return F.transform(cut, lambda s: F.sha2(s, 256))


def root(leaves: Column) -> Column:
    return F.sha2(F.array_join(sections(paragraphs(leaves)), " "), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves that two trees have in common (Dice)."""
    x, y = F.flatten(a), F.flatten(b)
    total = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, its root, and the digests of sections and paragraphs."""
    leaves = common.whole_texts(docs).select("did", tree(F.col("text")).alias("leaves"))
    return leaves.select(
        common.restore_id(),
        root(F.col("leaves")).alias("fingerprint"),
        sections(paragraphs(F.col("leaves"))).alias("sections"),
        paragraphs(F.col("leaves")).alias("paragraphs"),
        "leaves",
    )


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where two versions differ: one row per paragraph that only one of them has.

    Both tables come from ``fingerprints`` and have distinct doc_ids. Documents
    with equal roots are left out at once; in the others only paragraphs of
    sections that the other side lacks are looked at. Columns: doc_id, side
    (before or after), section, paragraph.
    """
    a = before.select("doc_id", "fingerprint", *(F.col(c).alias(f"{c}_a") for c in ("sections", "paragraphs")))
    b = after.select("doc_id", F.col("fingerprint").alias("other"), *(F.col(c).alias(f"{c}_b") for c in ("sections", "paragraphs")))
    both = a.join(b, "doc_id").where(F.col("fingerprint") != F.col("other"))
    sides = []
    for side, own, other in (("before", "a", "b"), ("after", "b", "a")):
        numbered = both.select(
            "doc_id",
            f"sections_{own}",
            f"sections_{other}",
            f"paragraphs_{other}",
            F.posexplode(f"paragraphs_{own}").alias("paragraph", "digest"),
        )
        # a section's number is the count of section starts up to its paragraph, the first paragraph aside
        begins = F.when((F.col("paragraph") > 0) & F.col("digest").rlike("^[01]"), 1).otherwise(0)
        order = Window.partitionBy("doc_id").orderBy("paragraph")
        section = F.sum(begins).over(order)
        sides.append(
            numbered.withColumn("section", section)
            .where(~F.array_contains(f"sections_{other}", F.element_at(f"sections_{own}", (F.col("section") + 1).cast("int"))))
            .where(~F.array_contains(f"paragraphs_{other}", F.col("digest")))
            .select("doc_id", F.lit(side).alias("side"), F.col("section").cast("int").alias("section"), "paragraph")
        )
    return sides[0].unionByName(sides[1])


def following(texts: DataFrame, segment: int) -> DataFrame:
    """(did, text, next_text): each text with that of the next row by (did, text), the last with the first.

    Rows are brought together by ``did div segment``, a fixed number of ids, so
    texts are shuffled once and no task holds more than a segment of them at a
    time. Where the next id is in another segment (one row per segment), the
    next row is copied to the segment of its predecessor. Which ids those are
    is found on the ids alone, in range partitions written to the scratch folder.
    """
    spark = texts.sparkSession
    part_of = F.floor(F.col("did") / F.lit(segment))
    ids = texts.select("did").distinct()
    ids = ids.repartitionByRange("did").select("did", F.spark_partition_id().alias("part"))
    ids = common.settle(ids, "ids")
    inside = ids.withColumn("next_did", F.lead("did").over(Window.partitionBy("part").orderBy("did")))
    # one row per range partition
    firsts = ids.groupBy("part").agg(F.min("did").alias("first_did"), F.max("did").alias("did"))
    beyond = firsts.select(
        "did",
        F.coalesce(
            F.lead("first_did").over(Window.orderBy("part")),
            F.min("first_did").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("beyond_did"),
    )
    pairs = inside.join(beyond, "did", "left").select(
        "did", F.coalesce("next_did", "beyond_did").alias("next_did"), F.col("next_did").isNull().alias("outer")
    )
    wraps = F.col("next_did") <= F.col("did")
    crossing = pairs.select(
        F.col("next_did").alias("did"),
        part_of.alias("segment"),
        F.when(wraps, 2).otherwise(1).alias("place"),
        wraps.alias("wraps"),
        F.floor(F.col("next_did") / F.lit(segment)).alias("next_segment"),
    ).where(F.col("wraps") | (F.col("segment") != F.col("next_segment")))
    crossing = common.settle(crossing.select("did", "segment", "place"), "crossing")
    rows = texts.select("did", "text", part_of.alias("segment"), F.lit(0).alias("place"))
    copies = texts.join(crossing, "did").select("did", "text", "segment", "place")
    order = Window.partitionBy("segment").orderBy("place", "did", "text")
    return rows.unionByName(copies).withColumn("next_text", F.lead("text").over(order))


def edited_pairs(docs: DataFrame, segment: int = 1024) -> DataFrame:
    """The query's table: every text, its edited form and the next text, by their fingerprints."""
    paired = following(common.whole_texts(docs), segment)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)
    )
    grown = paired.select("did", "segment", "place", "text", n.cast("long").alias("n_chars"), edited.alias("edited")).select(
        "did",
        "segment",
        "place",
        "text",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("leaves"),
        tree(F.col("edited")).alias("edited_leaves"),
    )
    order = Window.partitionBy("segment").orderBy("place", "did", "text")
    beside = grown.withColumn("next_leaves", F.lead("leaves").over(order)).where(F.col("place") == 0)
    return beside.select(
        common.restore_id(),
        "n_chars",
        "edited_sha256",
        root(F.col("leaves")).alias("fingerprint"),
        root(F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )
