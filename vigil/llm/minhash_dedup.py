"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is its set of word shingles; its signature has one minimum per
coordinate. Two documents agree on a coordinate with a probability equal to the
Jaccard similarity of their sets, so a pair over the threshold agrees on at
least ``matches`` coordinates but for a chance of ``loss``.

* Documents with equal sets are one class, found by a digest of the set.
* Representatives are posted under each (coordinate, value). Postings are
  ordered by the documents they hold, rarest first. A pair with ``matches`` agreements among K
  misses K - matches at most, so it meets under one of the first
  K - matches + 1 postings of either document: only those are kept. Values
  that many documents share by chance are thus skipped.
* Under a posting with several documents, pairs are formed with a pivot, not with
  each other; agreements are counted on the whole signatures, pairs below
  ``matches`` dropped, and the document's best pair confirmed on the full sets.
  Linked documents get one label. Further rounds take other pivots.
* Postings whose documents still bear several labels are then joined in
  full, but only across labels, and without the pairs of the label that holds
  most: a hot group of copies is one label by now, and a pair it forms with
  an outsider is the only kind left. Copies too far apart to be linked would still form
  all their pairs; each is first compared with one hub of the posting, and what sets it apart from
  the hub bounds its distance from all others (``told_by_hubs``). All pairs that this and the agreements
  leave are confirmed on the full sets, so no link that joins two labels is lost.

Hot postings are aggregated before they are shuffled, and joined with written
tables, so that adaptive execution can split them.

Defined results: null and empty texts, and texts without words, have 0
shingles and are linked with nothing; rows equal in doc_id and text are one
document; a null doc_id sorts first and is its own smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common, repeats, spans
from vigil.llm.components import components

_DRAWS = np.random.default_rng(5)
SEEDS = _DRAWS.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# pivots that a document is compared with in a round
PIVOTS = 2
# words of the bitmap by which texts are told that can be in no pair
BITMAP = 1 << 18

SIGNED = pa.schema(
    [
        ("did", pa.int64()),
        ("uid", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest_a", pa.int64()),
        ("digest_b", pa.int64()),
        ("signature", pa.list_(pa.int32())),
    ]
)
SIGNED_SQL = "did long, uid long, n_shingles long, digest_a long, digest_b long, signature array<int>"


def least_matches(coordinates: int, similarity: float, loss: float) -> int:
    """Most agreements that a pair of this similarity reaches but for a chance of ``loss``."""
    below = 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > loss:
            return max(1, m)
    return coordinates


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text, and where each text's begin."""
    words = spans.split_words(texts, lower=True)
    sizes = np.diff(words.bounds)
    counts = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = words.bounds[owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    ends = np.minimum(starts + width, words.bounds[owner + 1])
    hashes = spans.Rolling(words.codes).spans(starts, ends)
    _, kept = np.unique(hashes + spans.mix(owner.astype(np.uint64) + np.uint64(7)), return_index=True)
    kept.sort()
    return hashes[kept], np.searchsorted(owner[kept], np.arange(len(texts) + 1))


def signer(width: int, coordinates: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            hashes, bounds = shingles(common.texts_of(batch), width)
            rows = batch.num_rows
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            signature = np.zeros((rows, coordinates), dtype=np.uint32)
            digests = np.zeros((2, rows), dtype=np.uint64)
            if len(full):
                heads = bounds[:-1][full]
                for k in range(coordinates):
                    values = ((hashes ^ SEEDS[0, k]) * SEEDS[1, k]) >> np.uint64(32)
                    signature[full, k] = np.minimum.reduceat(values, heads)
                for k in range(2):
                    digests[k, full] = np.add.reduceat(spans.mix(hashes ^ SEEDS[k, 255]), heads)
            lists = pa.ListArray.from_arrays(
                np.arange(rows + 1, dtype=np.int32) * coordinates, signature.reshape(-1).view(np.int32)
            )
            yield common.pack(SIGNED, batch.column(0), batch.column(2), counts, *digests.view(np.int64), lists)

    return sign


def shingle_sets(texts: DataFrame, width: int, name: str) -> DataFrame:
    """``texts`` with its whole distinct shingle set, as 64-bit hashes, in place of the text; all else is of type long."""
    others = [c for c in texts.columns if c != "text"]
    schema = pa.schema([*((c, pa.int64()) for c in others), (name, pa.list_(pa.int64()))])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            hashes, bounds = shingles(common.texts_of(batch), width)
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), hashes.view(np.int64))
            yield common.pack(schema, *(batch.column(batch.schema.get_field_index(c)) for c in others), lists)

    return texts.mapInArrow(listed, ", ".join([*(f"{c} long" for c in others), f"{name} array<long>"]))


def likely_members(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose uid is among ``members``, and some others.

    A bitmap of hashed uids, ``BITMAP`` words of 64 bits whatever the number of members, is
    broadcast, so that texts that are out of question are not shuffled. The more members there are, the
    more others pass; the caller joins for certain.
    """
    place = F.xxhash64("uid", F.lit(11))
    word, bit = F.pmod(place, F.lit(BITMAP)).alias("word"), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(uid, 11), 32), 64) AS int))")
    bits = members.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    hashed = rows.withColumns({"word": F.pmod(place, F.lit(BITMAP)), "bit": bit})
    return hashed.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*rows.columns)


def agreements(a: str, b: str) -> Column:
    """Coordinates on which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def over(percent: int, n_a: Column, n_b: Column, shared: Column) -> Column:
    return shared * 100 >= (n_a + n_b - shared) * percent


class Join:
    """State of one run: representatives, postings, full sets and labels."""

    def __init__(self, reps: DataFrame, texts: DataFrame, width: int, percent: int, coordinates: int, loss: float):
        self.percent = percent
        self.matches = least_matches(coordinates, percent / 100, loss)
        prefix = coordinates - self.matches + 1
        self.reps = reps  # uid, n_shingles, signature
        every = reps.select("uid", F.posexplode("signature").alias("place", "value")).select(
            "uid", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value")).alias("posting")
        )
        held = common.settle(every.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1"), "held")
        rarest = Window.partitionBy("uid").orderBy(F.coalesce("n", F.lit(1)), "posting")
        first = every.join(held, "posting", "left").withColumn("rank", F.row_number().over(rarest))
        first = common.settle(first.where((F.col("rank") <= prefix) & F.col("n").isNotNull()).select("uid", "posting"), "first")
        shared = common.settle(first.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1").select("posting"), "shared")
        postings = first
        self.postings = common.settle(postings.join(shared, "posting", "left_semi"), "postings")
        known = reps.select("uid", "n_shingles")
        alone = self.postings.select("uid").distinct().join(known, "uid").withColumn("label", F.col("uid"))
        self.labels = common.settle(alone, "labels")  # uid, n_shingles, label
        # only these documents can be in a pair; one row per uid
        # an inner join, as a semi-join would be pushed below the one with the bitmap
        likely = likely_members(texts, self.labels).join(self.labels.select("uid"), "uid")
        self.texts, self.width = common.settle(likely, "texts"), width

    def labelled(self) -> DataFrame:
        return self.postings.join(self.labels, "uid")

    def counted(self, pairs: DataFrame, percent: int, matches: int) -> DataFrame:
        """Pairs (a, b) with enough agreements and sizes that allow a similarity of ``percent``."""
        a = self.reps.select(F.col("uid").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
        b = self.reps.select(F.col("uid").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        return (
            pairs.join(a, "a")
            .join(b, "b")
            .where(small * 100 >= large * percent)
            .withColumn("agreements", agreements("s_a", "s_b"))
            .where(F.col("agreements") >= matches)
            .select("a", "b", "n_a", "n_b", "agreements")
        )

    def confirm(self, pairs: DataFrame) -> None:
        """Confirm pairs on the full sets and give linked labels one label."""
        pairs = common.settle(pairs, "pairs")
        if pairs.isEmpty():
            return
        shared = F.size(F.array_intersect("x", "y"))
        both = self.with_sets(pairs.select("a", "b", "n_a", "n_b"))
        links = both.where(over(self.percent, F.col("n_a"), F.col("n_b"), shared)).select("a", "b")
        label = self.labels.select(F.col("uid").alias("a"), F.col("label").alias("l_a"))
        other = self.labels.select(F.col("uid").alias("b"), F.col("label").alias("l_b"))
        edges = links.join(label, "a").join(other, "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))
        joined = components(edges).select(F.col("node").alias("label"), "component")
        after = self.labels.join(joined, "label", "left").select("uid", "n_shingles", F.coalesce("component", "label").alias("label"))
        self.labels = common.settle(after, "labels")

    def pivot_round(self, salt: int) -> None:
        """Each document's best pair with the pivots of its postings; the salt chooses the pivots."""
        rows = self.labelled()
        pivot = F.min_by("uid", F.xxhash64("uid", F.lit(salt))) if salt else F.min("uid")
        several = rows.groupBy("posting").agg(pivot.alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high"))
        several = several.where("low != high").select("posting", "pivot")
        own = self.labels.select(F.col("uid").alias("pivot"), F.col("label").alias("pivot_label"), F.col("n_shingles").alias("pivot_n"))
        several = common.settle(several.join(own, "pivot"), "pivots")
        near = F.least("n_shingles", "pivot_n") * 100 >= F.greatest("n_shingles", "pivot_n") * self.percent
        pairs = rows.join(several, "posting").where((F.col("label") != F.col("pivot_label")) & near)
        # the pivots met most often are looked at; what that leaves out is found across labels
        met = pairs.groupBy(F.col("uid").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("met"))
        often = Window.partitionBy("a").orderBy(F.desc("met"), "b")
        pairs = met.withColumn("place", F.row_number().over(often)).where(F.col("place") <= PIVOTS).select("a", "b")
        best = Window.partitionBy("a").orderBy(F.desc("agreements"), "b")
        self.confirm(self.counted(pairs, self.percent, self.matches).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"))

    def told_by_hubs(self, pairs: DataFrame) -> DataFrame:
        """(uid, hub, apart, shared): how a document differs from a hub that it resembles.

        ``apart`` counts the shingles that one of the two has and the other lacks, ``shared`` those of them that
        set another document apart from this hub as well. Two documents a and b differ in
        apart_a + apart_b - 2 * (what sets both apart), and the latter is ``shared`` of either at most. So a lower
        bound for their difference follows without looking at the pair.
        """
        # the bound holds for any document; far ones have long differences and are left untold
        pairs = common.settle(self.counted(pairs, self.percent // 2, self.matches // 2).select("a", "b"), "resembling")
        differ = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
        marks = self.with_sets(pairs).select(F.col("a").alias("uid"), F.col("b").alias("hub"), F.explode_outer(differ).alias("shingle"))
        marks = common.settle(marks, "marks")
        often = marks.where("shingle is not null").groupBy("hub", "shingle").agg(F.count("*").alias("n")).where("n > 1")
        often = common.settle(often.select("hub", "shingle", F.lit(1).alias("one")), "often")
        told = marks.join(often, ["hub", "shingle"], "left").groupBy("uid", "hub")
        return common.settle(told.agg(F.count("shingle").alias("apart"), F.count("one").alias("shared")), "told")

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the sets x of a and y of b.

        The set of a is made where its text meets the pair, so it is shuffled once, to its b; no set is written.
        """
        x = shingle_sets(pairs.join(self.texts.select(F.col("uid").alias("a"), "text"), "a"), self.width, "x")
        others = self.texts.select(F.col("uid").alias("b"), "text").join(pairs.select("b").distinct(), "b", "left_semi")
        return x.join(shingle_sets(others, self.width, "y"), "b")

    def across_labels(self) -> None:
        """All pairs of different labels under a posting, those of its largest label aside."""
        rows = self.labelled().drop("n_shingles")
        sizes = rows.groupBy("posting", "label").agg(F.count("*").alias("n"))
        order = Window.partitionBy("posting").orderBy(F.desc("n"), "label")
        ranked = sizes.withColumn("place", F.row_number().over(order))
        several = ranked.where("place > 1").select("posting").distinct()
        largest = common.settle(ranked.where("place = 1").join(several, "posting", "left_semi").select("posting", F.col("label").alias("most")), "largest")
        met = rows.join(largest, "posting").join(self.reps, "uid")
        met = common.settle(met.select("posting", "uid", "label", "most", "n_shingles", "signature"), "met")
        hubs = met.where("label = most").groupBy("posting").agg(F.min("uid").alias("hub"))
        met = met.join(common.settle(hubs, "hubs"), "posting")
        told = self.told_by_hubs(met.where("uid != hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct())
        held = self.postings.groupBy("uid").agg(F.collect_list("posting").alias("postings"))
        met = common.settle(met.join(told, ["uid", "hub"], "left").drop("hub").join(held, "uid"), "met")
        names = ("uid", "label", "n_shingles", "signature", "apart", "shared", "postings")
        a = met.where("label != most").select("posting", *(F.col(c).alias(f"{c}_a") for c in names))
        b = met.select("posting", "most", *(F.col(c).alias(f"{c}_b") for c in names))
        excess = F.col("apart_a") + F.col("apart_b") - 2 * F.least("shared_a", "shared_b")
        allowed = (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - self.percent)
        near = F.col("apart_a").isNull() | F.col("apart_b").isNull() | (excess * (100 + self.percent) <= allowed)
        small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
        meet = (
            (a["posting"] == b["posting"])
            & ((F.col("label_b") == F.col("most")) | (F.col("label_a") < F.col("label_b")))
            & (small * 100 >= large * self.percent)
            & near
            & (agreements("signature_a", "signature_b") >= self.matches)
            # a pair counts under the first posting that both have
            & (F.array_min(F.array_intersect("postings_a", "postings_b")) == a["posting"])
        )
        pairs = a.join(b, meet).select(
            F.col("uid_a").alias("a"), F.col("uid_b").alias("b"), F.col("n_shingles_a").alias("n_a"), F.col("n_shingles_b").alias("n_b")
        )
        self.confirm(pairs)


def cluster(docs: DataFrame, *, width: int = 3, percent: int = 85, coordinates: int = 24, loss: float = 1e-6, rounds: int = 3) -> DataFrame:
    """(did, text_uid, n_shingles, component) of every row; component is a uid (see ``repeats.unique_ids``)."""
    # a batch of rows is in memory several times over, on both sides of the pipe to Python
    with common.batch_rows(docs.sparkSession, 1000):
        return classes_of(repeats.unique_ids(docs), width, percent, coordinates, loss, rounds)


def classes_of(texts: DataFrame, width: int, percent: int, coordinates: int, loss: float, rounds: int) -> DataFrame:
    """``cluster`` of the rows (did, text, uid)."""
    signed = common.settle(texts.mapInArrow(signer(width, coordinates), SIGNED_SQL), "signed")
    full = signed.where("n_shingles > 0")
    key = ["digest_a", "digest_b", "n_shingles"]
    classes = common.settle(full.groupBy(*key).agg(F.min("uid").alias("rep")), "classes")
    members = common.settle(full.join(classes, key).select("uid", "rep", "n_shingles", "signature"), "members")
    reps = members.where("uid = rep").select("uid", "n_shingles", "signature").dropDuplicates(["uid"])
    reps = common.settle(reps, "reps")
    single = texts.dropDuplicates(["uid"]) if signed.groupBy("uid").count().where("count > 1").count() else texts
    state = Join(reps, single.select("uid", "text"), width, percent, coordinates, loss)
    for salt in range(rounds):
        state.pivot_round(salt)
    state.across_labels()
    labels = state.labels.select(F.col("uid").alias("rep"), "label")
    placed = members.select("uid", "rep").distinct().join(labels, "rep", "left")
    placed = placed.select("uid", F.coalesce("label", "rep").alias("component"))
    out = signed.select("did", "uid", "n_shingles").join(placed, "uid", "left")
    return out.select("did", "uid", "n_shingles", F.coalesce("component", "uid").alias("component"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    rows = cluster(docs, **options)
    ids = rows.select(F.col("uid").alias("component"), F.col("did").alias("component_did")).distinct()
    named = rows.join(common.settle(ids, "ids"), "component")
    return named.select(
        common.restore_id(),
        "n_shingles",
        F.when(F.col("component_did") != common.NO_ID, F.col("component_did")).alias("component_id"),
        (F.col("did") == F.col("component_did")).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) without near-duplicates of a smaller doc_id.

    Documents without words have no duplicates and stay. Of rows equal in doc_id and text one stays.
    """
    rows = cluster(docs, **options)
    kept = common.settle(rows.where("uid = component").select("uid").distinct(), "kept")
    found = repeats.unique_ids(docs, F.col("text").alias("whole"), "lang", "source", "n_chars")
    found = found.join(kept, "uid", "left_semi")
    if repeats.ids_repeat(docs):
        found = found.dropDuplicates(["uid"])
    return found.select(common.restore_id(), F.col("whole").alias("text"), "lang", "source", "n_chars")
