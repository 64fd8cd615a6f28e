"""Language-model scores by deleted interpolation of word n-grams.

The tokens of a text are its words and one end; before a text stand two starts. The model is

    P(token | two before) = mixture of the maximum-likelihood estimates of order 3, 2 and 1 and the uniform one

over the whole training vocabulary, one share going to tokens it does not hold. The weights depend
on how often the context was seen (buckets by powers of two) and are learned by
expectation-maximisation: counts are deleted of the documents of one training fold, and the weights
make that fold likeliest. The estimates themselves then use all training documents.

All documents are tokenised once, into units: packed arrays of a batch of documents with
a dictionary of its own. A unit counts its distinct words, bigrams and trigrams and asks for their
counts in all units, in one row per range of their hashes; the number of ranges grows with the
tokens, so that a range holds a bounded number of n-grams. However frequent an n-gram is, it is
there once per unit. The replies go back to the unit. The driver gets totals and, in every round,
the sums of 64 context buckets.

N-grams are told apart by 64-bit hashes, as words are.

Defined results: null and empty texts are an end alone; a null doc_id is in
fold 0 and so a training document; every row is a document of its own, also
if it is repeated. With no training document every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import common, spans

END_CODE = np.uint64(0x243F6A8885A308D3)
TRAIN, DELETED, HELD_OUT = 0, 1, 2
UNIT_BYTES = 4 << 20
# tokens of all documents for each range of hashes
RANGE_TOKENS = 1 << 19
# rows handed to Python at once while units are made, and tokens scored at once
ROWS = 1000
PIECE = 1 << 16
# before a text, and what tells bigrams from trigrams
START_CODE = np.uint64(0x13198A2E03707345)
MIX_ONE, MIX_TWO = np.uint64(0xA4093822299F31D1), np.uint64(0x082EFA98EC4E6C89)
BIGRAM, TRIGRAM = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6D)

UNITS_SQL = "unit long, tokens long, dids binary, folds binary, lengths binary, places binary, words binary"
ASKED_SQL = "part int, unit long, sizes binary, grams binary, train binary, deleted binary"
REPLIES_SQL = "unit long, part int, sizes binary, train binary, deleted binary, kinds long, train_tokens long, deleted_tokens long"
EVENTS_SQL = "times binary, three binary, under_three binary, two binary, under_two binary, one binary"
SUMS_SQL = "cell int, share double"
SCORED_SQL = "did long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sql_to_arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time as units are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def tighten(values: np.ndarray) -> bytes:
    """64-bit numbers, packed with equal bytes of all of them side by side."""
    return squeeze(values.view(np.uint8).reshape(-1, 8).T)


def untighten(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def row_of(schema: pa.Schema, *values) -> pa.RecordBatch:
    return common.pack(schema, *([v] for v in values))


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack batches of (did, fold, text) into units with dictionaries; those of the deletion fold have odd numbers.

    A unit goes on over batches, so these can be small.
    """
    number, base = 0, TaskContext.get().partitionId() << 32
    waiting: list[list[pa.RecordBatch]] = [[], []]
    filled = [0, 0]
    for batch in batches:
        deletion = np.asarray(batch.column(1)) == DELETED
        for kind in (0, 1):
            rest = batch.filter(pa.array(deletion == kind))
            while rest.num_rows:
                ends = np.cumsum([len(t) for t in common.texts_of(rest)])
                fits = int(np.searchsorted(ends, UNIT_BYTES - filled[kind], side="right"))
                if not waiting[kind]:
                    fits = max(1, fits)
                if fits:
                    waiting[kind].append(rest.slice(0, fits))
                    filled[kind] += int(ends[fits - 1])
                    rest = rest.slice(fits)
                if rest.num_rows:
                    yield unit_row(waiting[kind], base + 2 * number + kind)
                    number, waiting[kind], filled[kind] = number + 1, [], 0
    for kind in (0, 1):
        if waiting[kind]:
            yield unit_row(waiting[kind], base + 2 * number + kind)
            number += 1


def unit_row(pieces: list[pa.RecordBatch], unit: int) -> pa.RecordBatch:
    codes, lengths = [], []
    for part in common.batches_of(iter(pieces)):
        words = spans.split_words(common.texts_of(part), lower=True)
        # every text's end follows its words
        lengths.append(np.diff(words.bounds) + 1)
        codes.append(np.insert(words.codes, words.bounds[1:], END_CODE))
    codes = np.concatenate(codes)
    words, places, seen = np.unique(codes, return_inverse=True, return_counts=True)
    del codes
    # most frequent first, as small numbers pack well
    order = np.argsort(-seen, kind="stable")
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    tokens, places = len(places), rank[places]
    return row_of(
        sql_to_arrow(UNITS_SQL),
        unit,
        tokens,
        b"".join(np.asarray(p.column(0)).tobytes() for p in pieces),
        b"".join(np.asarray(p.column(1)).astype(np.int8).tobytes() for p in pieces),
        np.concatenate(lengths).astype(np.int64).tobytes(),
        tighten(places),
        words[order].tobytes(),
    )


def before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value before each token, and ``first`` at the start of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


class Unit:
    """The n-grams of a unit: for order 1 to 3 their sorted hashes, and which of them ends at each token.

    Orders that are not wanted have no n-grams.
    """

    def __init__(self, row: dict, orders: tuple[int, ...] = (1, 2, 3)):
        words, places = np.frombuffer(row["words"], dtype=np.uint64), untighten(row["places"])
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.folds = np.frombuffer(row["folds"], dtype=np.int8)
        self.token_folds = np.repeat(self.folds, self.lengths)
        order = np.argsort(words)
        sorted_place = np.empty(len(words), dtype=np.uint32)
        sorted_place[order] = np.arange(len(words), dtype=np.uint32)
        self.grams, self.places = [words[order]], [sorted_place[places]]
        self.end = int(np.searchsorted(self.grams[0], END_CODE))
        here = words[places]
        one = before(here, self.starts, START_CODE)
        two = before(one, self.starts, START_CODE)
        pairs = one * MIX_ONE + here
        two *= MIX_TWO
        two += pairs
        del here, one, places, order, sorted_place
        for n in (2, 3):
            codes = np.zeros(0, dtype=np.uint64)
            if n in orders:
                codes = spans.mix(pairs + BIGRAM if n == 2 else two + TRIGRAM)
            grams, at = np.unique(codes, return_inverse=True)
            del codes
            self.grams.append(grams)
            self.places.append(at.astype(np.uint32))
        if 1 not in orders:
            self.grams[0], self.places[0] = self.grams[0][:0], self.places[0][:0]

    def counts(self, fold: int) -> list[np.ndarray]:
        """Occurrences of each n-gram in the unit's documents of a fold."""
        inside = self.token_folds == fold
        return [
            np.bincount(at[inside] if len(at) else at, minlength=len(g)) for at, g in zip(self.places, self.grams, strict=True)
        ]

    def replied(self, replies: list[dict], *names: str) -> list[np.ndarray]:
        """Occurrences of each n-gram in all documents of the named folds, by order."""
        found = [[], [], []]
        for reply in sorted(replies, key=lambda r: r["part"]):
            total = sum(untighten(reply[name]) for name in names)
            cuts = np.cumsum(np.frombuffer(reply["sizes"], dtype=np.int64))[:-1]
            for order, counts in zip(found, np.split(total, cuts), strict=True):
                order.append(counts)
        # each order's parts go as they are joined
        return [np.concatenate(found.pop(0)) for _ in range(3)]

    def contexts(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the two tokens and of the one token before each token."""
        # as many texts start as end
        texts = counts[0][self.end]
        return tuple(before(counts[k][self.places[k]], self.starts, texts) for k in (1, 0))


def asked_rows(parts: int, orders: tuple[int, ...]):
    """Per unit one row for each range of hashes: its n-grams of these orders and their counts there."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = sql_to_arrow(ASKED_SQL)
        edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row, orders)
                counts = [unit.counts(fold) for fold in (TRAIN, DELETED)]
                cuts = [np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g in unit.grams]
                for part in range(parts):
                    cut = [slice(c[part], c[part + 1]) for c in cuts]
                    sizes = np.array([c.stop - c.start for c in cut], dtype=np.int64)
                    if not sizes.any():
                        continue
                    grams = np.concatenate([g[c] for g, c in zip(unit.grams, cut, strict=True)])
                    seen = [np.concatenate([n[c] for n, c in zip(own, cut, strict=True)]) for own in counts]
                    # sorted hashes of one range lie close together
                    steps = np.diff(grams, prepend=np.uint64(0))
                    yield row_of(schema, part, row["unit"], sizes.tobytes(), tighten(steps), *map(tighten, seen))

    return asked


def reply_rows(table: pa.Table) -> pa.Table:
    """Counts over all units for the n-grams of one range; totals of its words stand in one row."""
    rows = table.to_pylist()
    sizes = [np.frombuffer(r["sizes"], dtype=np.int64) for r in rows]
    grams = np.concatenate([np.cumsum(untighten(r["grams"], np.uint64)) for r in rows])
    grams, places = np.unique(grams, return_inverse=True)
    totals = []
    for name in ("train", "deleted"):
        seen = np.concatenate([untighten(r[name]) for r in rows])
        totals.append(np.bincount(places, weights=seen, minlength=len(grams)).astype(np.int64))
    ends = np.cumsum([n.sum() for n in sizes])
    single = np.zeros(len(grams), dtype=bool)
    for n, end in zip(sizes, ends, strict=True):
        single[places[end - n.sum() : end - n.sum() + n[0]]] = True
    kinds = int(np.count_nonzero(totals[0][single] + totals[1][single]))
    sums = [kinds, *(int(t[single].sum()) for t in totals)]
    out = []
    for k, (r, n, end) in enumerate(zip(rows, sizes, ends, strict=True)):
        at = places[end - n.sum() : end]
        told = [tighten(t[at]) for t in totals]
        out.append((r["unit"], r["part"], r["sizes"], *told, *(sums if k == 0 else (0, 0, 0))))
    schema = sql_to_arrow(REPLIES_SQL)
    return pa.Table.from_batches([common.pack(schema, *map(list, zip(*out, strict=True)))])


def event_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per unit of the deletion fold its trigrams, with their counts in the other training documents."""
    schema = sql_to_arrow(EVENTS_SQL)
    for batch in batches:
        for row in rows_of(batch):
            unit = Unit(row)
            counts = unit.replied(row["replies"], "train")
            # any of the places where a trigram stands
            at = np.empty(len(unit.grams[2]), dtype=np.int64)
            at[unit.places[2]] = np.arange(len(unit.places[2]))
            under_three, under_two = unit.contexts(counts)
            one, two = (counts[k][unit.places[k][at]] for k in (0, 1))
            parts = (unit.counts(DELETED)[2], counts[2], under_three[at], two, under_two[at], one)
            yield row_of(schema, *map(tighten, parts))


def ratio(n: np.ndarray, total) -> np.ndarray:
    return np.divide(n, total, out=np.zeros(len(n)), where=np.broadcast_to(total, n.shape) > 0)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Contexts seen never, once, 2-3 times, 4-7 times, ..."""
    return np.frexp(context.astype(float))[1]


def first_weights() -> np.ndarray:
    weights = np.full((64, 4), 0.25)
    weights[0] = [0, 1 / 3, 1 / 3, 1 / 3]  # a context never seen says nothing
    return weights


def expected(weights: np.ndarray, parts: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """How many of the events each order accounts for, by context bucket (64 x 4)."""
    mixed = weights[bucket] * parts
    mixed *= (n / mixed.sum(axis=1))[:, None]
    return np.stack([np.bincount(bucket, weights=mixed[:, k], minlength=64) for k in range(4)], axis=1)


def next_weights(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    # one event spread evenly keeps every weight above 0, and buckets without events as they were
    sums = sums + weights
    return sums / sums.sum(axis=1, keepdims=True)


def event_sums(weights: np.ndarray, tokens: int, kinds: int):
    """One round of expectation: per unit (bucket * 4 + order, events it accounts for)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = sql_to_arrow(SUMS_SQL)
        for batch in batches:
            for row in rows_of(batch):
                times, three, under_three, two, under_two, one = (untighten(row[c.split()[0]]) for c in EVENTS_SQL.split(", "))
                shares = [ratio(three, under_three), ratio(two, under_two), ratio(one, tokens)]
                parts = np.stack([*shares, np.full(len(one), 1 / (kinds + 1))], axis=1)
                sums = expected(weights, parts, times, bucket_of(under_three)).reshape(-1)
                at = np.flatnonzero(sums)
                yield common.pack(schema, at.astype(np.int32), sums[at])

    return summed


# The same model with all counts in one array, for a vocabulary small enough for that.


def estimates(counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of order 3 to 0 for every trigram, and the bucket of every context.

    ``counts`` has the axes two before, one before, token. An estimate without a context is 0. The
    start class is no token, so it gets no share.
    """
    width = counts.shape[0]

    def share(n: np.ndarray) -> np.ndarray:
        total = n.sum(axis=-1, keepdims=True)
        return np.divide(n, total, out=np.zeros(n.shape), where=total > 0)

    pairs, single = counts.sum(axis=0), counts.sum(axis=(0, 1))
    uniform = np.full(width, 1 / (width - 1))
    uniform[-1] = 0
    orders = [share(counts), np.broadcast_to(share(pairs), counts.shape), np.broadcast_to(share(single), counts.shape)]
    orders.append(np.broadcast_to(uniform, counts.shape))
    return orders, bucket_of(counts.sum(axis=2))


def learn_weights(seen: np.ndarray, deleted: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights by context bucket (64 x 4), by expectation-maximisation on the deleted counts."""
    orders, buckets = estimates(seen)
    at = np.nonzero(deleted)
    n, bucket = deleted[at], buckets[at[:2]]
    parts = np.stack([o[at] for o in orders], axis=1)
    weights = first_weights()
    for _ in range(rounds):
        weights = next_weights(weights, expected(weights, parts, n, bucket))
    return weights


def class_scores(seen: np.ndarray, deleted: np.ndarray, rounds: int) -> np.ndarray:
    """log10 probability of every class trigram."""
    weights = learn_weights(seen, deleted, rounds)
    orders, buckets = estimates(seen + deleted)
    scores = sum(weights[buckets][:, :, None, k] * orders[k] for k in range(4))
    # where a context has no estimate of some order, its weight goes to the others
    scores /= np.maximum(scores.sum(axis=2, keepdims=True), 1e-300)
    with np.errstate(divide="ignore"):
        return np.log10(scores).reshape(-1)


def scored_rows(weights: np.ndarray, tokens: int, kinds: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = sql_to_arrow(SCORED_SQL)
        for batch in batches:
            for row in rows_of(batch):
                unit = Unit(row)
                counts = unit.replied(row["replies"], "train", "deleted")
                contexts = unit.contexts(counts)
                single = counts[0]
                logs = np.empty(len(contexts[0]))
                # piece by piece, as four weights a token are large
                for at in range(0, len(logs), PIECE):
                    piece = slice(at, at + PIECE)
                    own = weights[bucket_of(contexts[0][piece])].T
                    # where a context has no estimate of some order, its weight goes to the others
                    mixed, share = own[3] / (kinds + 1), own[3].copy()
                    for k, under in enumerate((*(c[piece] for c in contexts), np.int64(tokens))):
                        mixed += own[k] * ratio(counts[2 - k][unit.places[2 - k][piece]], under)
                        share += own[k] * (under > 0)
                    logs[piece] = np.log10(mixed / share)
                del contexts
                base = np.log10((single + 1) / (tokens + kinds + 1))
                yield common.pack(
                    schema,
                    np.frombuffer(row["dids"], dtype=np.int64),
                    unit.folds == HELD_OUT,
                    unit.lengths,
                    np.add.reduceat((single > 0).astype(np.int64)[unit.places[0]], unit.starts),
                    np.full(len(unit.lengths), tokens),
                    np.add.reduceat(base[unit.places[0]], unit.starts),
                    np.add.reduceat(logs, unit.starts),
                )

    return scored


def score(docs: DataFrame, *, folds: int = 7, held_out: int = 2, deleted: int = 3, rounds: int = 20) -> DataFrame:
    """One row per document: doc_id, held_out, token counts, base_score and the model's score."""
    fold = common.fold(folds)
    kind = F.when(fold == held_out, HELD_OUT).when(fold == deleted, DELETED).otherwise(TRAIN)
    texts = docs.select(
        common.doc_key().alias("did"), kind.alias("fold"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    with common.batch_rows(docs.sparkSession, ROWS):
        units = common.settle(texts.mapInArrow(unit_rows, UNITS_SQL), "units")
    parts = -(-(units.agg(F.sum("tokens")).first()[0] or 1) // RANGE_TOKENS)
    replies = []
    # in turn, as what is asked is the largest table
    for orders in ((3,), (1, 2)):
        asked = units.select("unit", "folds", "lengths", "places", "words").mapInArrow(asked_rows(parts, orders), ASKED_SQL)
        replies.append(common.settle(asked.groupBy("part").applyInArrow(reply_rows, REPLIES_SQL), "replies"))
        del asked
        common.collect_garbage(docs.sparkSession)
    replies = replies[0].union(replies[1])
    sums = replies.agg(*(F.sum(n) for n in ("kinds", "train_tokens", "deleted_tokens"))).first()
    kinds, train_tokens, deleted_tokens = (n or 0 for n in sums)

    def answered(some: Column) -> DataFrame:
        # few units in a task, as they go to Python in one batch
        told = replies.where(some).repartition(parts, "unit").groupBy("unit").agg(
            F.collect_list(F.struct("part", "sizes", "train", "deleted")).alias("replies")
        )
        return units.where(some).drop("tokens").repartition(parts, "unit").join(told, "unit")

    weights = first_weights()
    if deleted_tokens:
        packed = answered(F.col("unit") % 2 == 1).select("folds", "lengths", "places", "words", "replies")
        events = common.settle(packed.mapInArrow(event_rows, EVENTS_SQL), "events")
        for _ in range(rounds):
            found = events.mapInArrow(event_sums(weights, train_tokens, kinds), SUMS_SQL).groupBy("cell")
            # as decimals, so that the order of the units does not show; 64 x 4 rows at most
            rows = found.agg(F.sum(F.col("share").cast("decimal(28, 12)")).alias("share")).collect()
            table = np.zeros(64 * 4)
            table[[r["cell"] for r in rows]] = [float(r["share"]) for r in rows]
            weights = next_weights(weights, table.reshape(64, 4))
    out = answered(F.lit(True)).select("dids", "folds", "lengths", "places", "words", "replies").mapInArrow(
        scored_rows(weights, train_tokens + deleted_tokens, kinds), SCORED_SQL
    )
    return out.select(common.restore_id(), *(c.split()[0] for c in SCORED_SQL.split(", ")[1:]))
