"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Both tokenizers cut one byte string: a blank and the text. All tokens of both,
as intervals of bytes, are sorted by where they start, and the running
maximum of their ends is taken: a group ends where the next start reaches it.
So tokens whose ranges overlap, directly or through others, share a group, and
a group is the smallest range that both tokenizers cut at its two ends. Every
A token of a group is linked with every B token of it.

Texts are worked through in units of about ``UNIT`` bytes, many texts at a
time, as numpy arrays. A unit keeps its distinct id pairs with the number of
its documents that hold each, and for every document which of them it holds
and how often. The corpus counts a pair by adding up the units' numbers, so
what is shuffled are distinct pairs of units, not links; a pair that all
documents hold is one row per unit. Each unit then asks for the counts of its pairs
by a join, and gets the answers back in one group, bounded by the unit. The
highest count per A id is at most one row per entry of A's vocabulary, and
only that is broadcast.

Links of a group are the product of its two sides. Equal ids of a side are
counted before the product is formed, and the product is formed in pieces of
``PAIRS``, so a long stretch without a common cut takes time but no more memory
than its distinct pairs.

Defined results: texts that are null or empty, and texts that the tokens of
either side don't give back, have no tokens; repeated rows and rows with a
null doc_id count as documents of their own; an empty table gives an empty
result; the text of a special token is plain text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import bpe, common, piece_spans

UNIT = 1 << 20
PAIRS = 4 << 20
A, B = 0, 1


class Pair:
    """The two tokenizers: byte-level BPE (A) and sentence pieces (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a = bpe.codec(path_a)
        self.b = piece_spans.model(path_b)
        self.n_a = 1 + max(self.a.bytes_of)
        self.n_b = len(self.b.bytes_of)
        self.sizes_a = np.array([len(self.a.bytes_of.get(i, b"")) for i in range(self.n_a)])
        self.sizes_b = np.array(list(map(len, self.b.bytes_of)))
        # how each id is written: within a side, at the end of the A side, at the end of the B side
        self.written = np.array([f"{i}{end}" for end in ",|;" for i in range(max(self.n_a, self.n_b))], dtype=object)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides for a blank and the text; none if either side's bytes differ from these."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        wanted = b" " + text.encode()
        ids_a = self.a.encode_plain(" " + text)
        ids_b = self.b.encode(text)[0]
        if self.a.merging.decode_bytes(ids_a) != wanted or b"".join(map(self.b.bytes_of.__getitem__, ids_b.tolist())) != wanted:
            return none, none
        return np.array(ids_a, np.int64), ids_b.astype(np.int64)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """Tokens of several texts, ordered by group, side and place."""

    doc: np.ndarray
    side: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    group: np.ndarray  # numbered over all texts
    base: np.ndarray  # where each text's bytes begin
    n_a: np.ndarray
    n_b: np.ndarray


def align(pair: Pair, texts: list[str | None]) -> Aligned:
    """Group the tokens of every text; the texts' bytes lie one behind the other."""
    encoded = [pair.encode(t) for t in texts]
    n_a, n_b = (np.array([len(e[side]) for e in encoded], np.int64) for side in (A, B))
    columns = []
    base = np.zeros(len(texts), np.int64)
    for side, counts, sizes in ((A, n_a, pair.sizes_a), (B, n_b, pair.sizes_b)):
        ids = np.concatenate([e[side] for e in encoded]) if encoded else np.empty(0, np.int64)
        end = np.cumsum(sizes[ids])
        start = end - sizes[ids]
        first = np.cumsum(counts) - counts
        if side == A and len(ids):
            base = np.append(start, end[-1])[first]
        columns.append((np.repeat(np.arange(len(texts)), counts), np.full(len(ids), side), ids, start, end))
    doc, side, ids, start, end = (np.concatenate(c) for c in zip(*columns, strict=True))
    by_start = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[by_start])
    breaks = np.empty(len(by_start), bool)
    breaks[:1] = False
    breaks[1:] = start[by_start][1:] >= reached[:-1]
    group = np.cumsum(breaks)
    inner = np.argsort(2 * group + side[by_start], kind="stable")
    order = by_start[inner]
    return Aligned(doc[order], side[order], ids[order], start[order], end[order], group[inner], base, n_a, n_b)


def links(pair: Pair, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, A id, B id) as one number, and how many links each stands for."""
    if not len(found.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sides = 2 * found.group + found.side
    # equal ids of a side are counted first: their links are a product
    key, first, times = np.unique(sides * max(pair.n_a, pair.n_b) + found.ids, return_index=True, return_counts=True)
    doc, ids, group, side = found.doc[first], found.ids[first], found.group[first], found.side[first]
    is_a = side == A
    groups = int(group[-1]) + 1
    per_b = np.bincount(group[~is_a], minlength=groups)
    begin_b = np.cumsum(per_b) - per_b
    ids_b, times_b = ids[~is_a], times[~is_a]
    doc, ids, group, times = doc[is_a], ids[is_a], group[is_a], times[is_a]
    fan = per_b[group]
    done = np.cumsum(fan)
    keys, counts = [], []
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
        n = fan[at:to]
        total = int(n.sum())
        row = np.repeat(np.arange(at, to), n)
        b = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin_b[group[at:to]], n)
        key = (doc[row] * pair.n_a + ids[row]) * pair.n_b + ids_b[b]
        found_keys, number = summed(key, times[row] * times_b[b])
        keys.append(found_keys)
        counts.append(number)
        at = to
    return summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])


def summed(key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their numbers."""
    order = np.argsort(key, kind="stable")
    key, number = key[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(number, first)


def written_groups(pair: Pair, found: Aligned) -> list[str]:
    """Per text the ids of its groups as ``a1,a2|b1;a3|b2,b3``."""
    count = len(found.ids)
    if not count:
        return [""] * len(found.n_a)
    ends_side = np.ones(count, bool)
    ends_side[:-1] = (found.side[1:] != found.side[:-1]) | (found.group[1:] != found.group[:-1])
    form = np.where(ends_side, 1 + found.side, 0)
    words = pair.written[form * max(pair.n_a, pair.n_b) + found.ids].tolist()
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    return ["".join(words[a:b])[:-1] for a, b in zip([0, *ends], ends, strict=False)]


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, begin, end, a_ids, b_ids), a row per group: its range in the bytes of blank and text, and the ids of both sides."""
    schema = pa.schema(
        [("did", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        for batch in common.batches_of(batches):
            found = align(pair, batch.column(1).to_pylist())
            if not len(found.ids):
                continue
            first = np.flatnonzero(np.concatenate(([True], found.group[1:] != found.group[:-1])))
            doc = found.doc[first]
            begin = np.minimum.reduceat(found.start, first) - found.base[doc]
            end = np.maximum.reduceat(found.end, first) - found.base[doc]
            ids = []
            for side in (A, B):
                per = np.bincount(found.group[found.side == side], minlength=len(first))
                offsets = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
                ids.append(pa.ListArray.from_arrays(offsets, pa.array(found.ids[found.side == side].astype(np.int32))))
            yield common.pack(schema, batch.column(0).take(pa.array(doc)), begin, end, *ids)

    out = common.whole_texts(docs).mapInArrow(rows, "did long, begin long, end long, a_ids array<int>, b_ids array<int>")
    return out.select(common.restore_id(), "begin", "end", "a_ids", "b_ids")


UNITS = pa.schema(
    [
        ("unit", pa.int64()),
        ("pairs", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),
        ("dids", pa.list_(pa.int64())),
        ("figures", pa.list_(pa.list_(pa.int64()))),
        ("digests", pa.list_(pa.string())),
        ("held", pa.list_(pa.int32())),
        ("at", pa.binary()),
        ("times", pa.binary()),
    ]
)


def units(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The aligned corpus, written: a row per unit with its distinct pairs, its documents and what each of them holds.

    ``pairs`` are A id times the size of B's vocabulary plus B id, ``docs`` the documents of the unit with
    each. ``at`` and ``times`` are packed: for every document in turn its pairs' places in ``pairs``, and its links for each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in common.batches_of(batches, UNIT):
            found = align(pair, batch.column(1).to_pylist())
            key, times = links(pair, found)
            doc, id_pair = np.divmod(key, pair.n_a * pair.n_b)
            distinct, at, docs_with = np.unique(id_pair, return_inverse=True, return_counts=True)
            held = np.bincount(doc, minlength=batch.num_rows)
            starts = np.ones(len(found.group), bool)
            starts[1:] = found.group[1:] != found.group[:-1]
            n_groups = np.bincount(found.doc[starts], minlength=batch.num_rows)
            n_links = np.diff(np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(held)))])
            figures = np.stack([found.n_a, found.n_b, n_groups, n_links], axis=1)
            digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written_groups(pair, found)]
            packed = (zlib.compress(x.astype("<i4").tobytes(), 1) for x in (at, times))
            yield common.pack(
                UNITS,
                *([x] for x in (number, distinct, docs_with.astype(np.int32), batch.column(0).to_pylist(), figures.tolist(), digests)),
                [held.astype(np.int32)],
                *([x] for x in packed),
            )
            number += 1

    schema = (
        "unit long, pairs array<long>, docs array<int>, dids array<long>, figures array<array<long>>,"
        " digests array<string>, held array<int>, at binary, times binary"
    )
    return common.settle(common.whole_texts(docs).mapInArrow(rows, schema), "aligned")


def pair_counts(made: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): how many documents hold each id pair linked, and whether no pair of its A id has more."""
    n_b = tokenizers(path_a, path_b).n_b
    each = made.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n_docs"))
    counted = counted.withColumns({"a_id": F.floor(F.col("pair") / n_b), "b_id": F.col("pair") % n_b})
    # one row per entry of A's vocabulary at most
    highest = F.broadcast(counted.groupBy("a_id").agg(F.max("n_docs").alias("highest")))
    return counted.join(highest, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))


SUMMARY = (
    "did long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
SUMMARY_ARROW = pa.schema(
    [("did", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())]
)


def summaries(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its tokens, groups and links, how many of its links are their A id's most frequent, and the sum of their counts."""

    def told(unit: pa.Table, answers: pa.Table) -> pa.Table:
        row = unit.slice(0, 1).to_pylist()[0]
        count, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), bool)
        place = answers.column("place").to_numpy()
        count[place] = answers.column("n_docs").to_numpy()
        best[place] = answers.column("best").to_numpy(zero_copy_only=False)
        at, times = (np.frombuffer(zlib.decompress(row[k]), "<i4").astype(np.int64) for k in ("at", "times"))
        ends = np.concatenate(([0], np.cumsum(row["held"], dtype=np.int64)))
        per_doc = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (times * best[at], times * count[at])]
        figures = np.array(row["figures"], np.int64).reshape(-1, 4).T
        return pa.Table.from_arrays(
            [pa.array(c) for c in (row["dids"], *figures, *per_doc, row["digests"])], schema=SUMMARY_ARROW
        )

    made = units(docs, path_a, path_b)
    counts = pair_counts(made, path_a, path_b).select("pair", "n_docs", "best")
    asked = made.select(F.col("unit").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("of", "place", "n_docs", "best")
    out = made.drop("docs").groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(told, SUMMARY)
    return out.select(common.restore_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
