"""Windows that occur again, found through content-chosen anchors.

Both removal operators ask which windows (a fixed number of words or bytes)
also start earlier. Every window picks an anchor gram by its content alone
(``spans.winnow``), so equal windows meet under the same gram, and only one
row per run of windows is shuffled:

1. Each run of windows with one anchor becomes a row (gram, hash of the whole
   run's symbols, document, start). Runs equal to an earlier one of the same
   Arrow batch are settled on the spot, so a gram gets no more than one row per
   batch and surroundings, however hot it is.
2. Under a gram, runs with equal symbols are settled: all but the first occur
   earlier as a whole. Grams with a single run are dropped.
3. What is left are first runs whose gram has other surroundings as well. Only
   their symbols are sent on, and the operator's own method compares them.

Runs of documents without such rows are complete after step 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common, spans

RUNS = pa.schema([("gram", pa.int64()), ("block", pa.int64()), ("uid", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])
RUNS_SQL = "gram long, block long, uid long, first int, count int"
BLOCKS_SQL = "gram long, uid long, first int, count int, symbols binary"
BLOCKS = pa.schema(
    [("gram", pa.int64()), ("uid", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("symbols", pa.binary())]
)
FOUND = pa.schema([("uid", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])
FOUND_SQL = "uid long, first int, count int"
# symbols compared at a time in one task, in bytes; groups of a gram stay together. A comparison takes some
# hundred times as much memory, as each place of a window has a number in a dozen arrays
COMPARED = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    words: bool
    window: int
    gram: int

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, spans.Words | None]:
        """Codes of all texts, where each text begins, and the words if there are any."""
        if self.words:
            words = spans.split_words(texts, lower=False)
            return words.codes, words.bounds, words
        data, bounds = spans.join_texts(texts)
        return spans.BYTE_CODES[data], bounds, None


def ids_repeat(docs: DataFrame) -> bool:
    """Whether rows share a doc_id."""
    ids = docs.select(common.doc_key().alias("did"))
    return not ids.groupBy("did").count().where("count > 1").isEmpty()


def unique_ids(docs: DataFrame, *more: str) -> DataFrame:
    """(did, text, uid) and the columns ``more``: uid tells documents apart and rises with (doc_id, text hash).

    It is the doc_id itself unless rows share one. Rows that are equal in both
    are one document that stands there several times: they share a uid.
    """
    texts = common.whole_texts(docs, *more)
    if not ids_repeat(docs):
        return texts.select("did", "text", F.col("did").alias("uid"), *more)
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    pairs = keyed.select("did", "text_key").distinct().repartitionByRange("did", "text_key")
    pairs = common.settle(pairs.select("did", "text_key", F.spark_partition_id().alias("part")), "ids")
    # one row per range partition
    sizes = pairs.groupBy("part").agg(F.count("*").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("did", "text_key"))
    numbered = pairs.join(offsets, "part").select("did", "text_key", (place + F.col("offset")).cast("long").alias("uid"))
    numbered = common.settle(numbered, "uids")
    return keyed.join(numbered, ["did", "text_key"]).select("did", "text", "uid", *more)


def run_rows(unit: Unit, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of runs; a negative count marks windows known to occur earlier."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in common.batches_of(iter([batch])):
                texts = common.texts_of(piece)
                ids = np.asarray(piece.column(piece.schema.get_field_index("uid")))
                codes, bounds, _ = unit.symbols(texts)
                runs, rolling = spans.winnow(codes, bounds, unit.window, unit.gram)
                if len(runs.first):
                    whole = rolling.spans(runs.first, runs.first + runs.count - 1 + unit.window)
                    parts.append((runs.grams, whole, ids[runs.text], runs.first - bounds[runs.text], runs.count))
            if not parts:
                continue
            gram, block, uid, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not every:
                order = np.lexsort((first, uid, block, gram))
                gram, block, uid, first, count = (x[order] for x in (gram, block, uid, first, count))
                again = np.zeros(len(gram), dtype=bool)
                again[1:] = (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
                # the same document read twice is no earlier occurrence
                again[1:] &= (uid[1:] != uid[:-1]) | (first[1:] != first[:-1])
                known = merged(uid[again], first[again], count[again])
                own = spans.mix(known[0].astype(np.uint64) + np.uint64(1))
                gram = np.concatenate([gram[~again], own])
                block = np.concatenate([block[~again], spans.mix(own + known[1].astype(np.uint64))])
                uid = np.concatenate([uid[~again], known[0]])
                first = np.concatenate([first[~again], known[1]])
                count = np.concatenate([count[~again], -known[2]])
            for at in range(0, len(gram), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield common.pack(
                    RUNS,
                    gram[cut].view(np.int64),
                    block[cut].view(np.int64),
                    uid[cut],
                    first[cut].astype(np.int32),
                    count[cut].astype(np.int32),
                )

    return found


def merged(uid: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows as maximal runs, ordered by document and start."""
    if not len(uid):
        return uid, first, count
    order = np.lexsort((first, uid))
    uid, first, end = uid[order], first[order].astype(np.int64), (first + count)[order].astype(np.int64)
    # ends so far within the document: documents are lifted above one another
    new_doc = np.concatenate([[True], uid[1:] != uid[:-1]])
    lift = (np.cumsum(new_doc) - 1) << 33
    reach = np.maximum.accumulate(end + lift) - lift
    starts = np.concatenate([[True], new_doc[1:] | (first[1:] > reach[:-1])])
    at = np.flatnonzero(starts)
    last = np.concatenate([at[1:], [len(uid)]]) - 1
    return uid[at], first[at], reach[last] - first[at]


def classified(runs: DataFrame, every: bool) -> DataFrame:
    """(uid, first, count, gram, open): settled runs, and open ones that are to be compared.

    One shuffle, by gram; the sort spills. Rows of a gram are bounded by
    batches and distinct surroundings, not by its occurrences.
    """
    under = Window.partitionBy("gram")
    beside = under.orderBy("block", "uid", "first")
    if every:
        compared = F.count("*").over(under) > 1
        return runs.withColumn("open", compared).where("open").select("uid", "first", "count", "gram", "open")
    # equal rows of one document that stands there several times count once
    other = (F.lag("uid").over(beside) != F.col("uid")) | (F.lag("first").over(beside) != F.col("first"))
    again = F.coalesce((F.lag("block").over(beside) == F.col("block")), F.lit(False))
    several = F.min("block").over(under) != F.max("block").over(under)
    marked = runs.select("*", again.alias("again"), F.coalesce(other, F.lit(True)).alias("other"), several.alias("several"))
    settled = (F.col("count") < 0) | (F.col("again") & F.col("other"))
    return marked.where(settled | (F.col("several") & ~F.col("again"))).select(
        "uid", "first", F.abs("count").alias("count"), "gram", (~settled).alias("open")
    )


def by_document(marks: DataFrame, *columns: str) -> DataFrame:
    """Marks of each document in one row; a document has no more of them than symbols."""
    return marks.groupBy("uid").agg(F.collect_list(F.struct("first", "count", *columns)).alias("marks"))


def find(
    texts: DataFrame,
    unit: Unit,
    compare: Callable,
    finish: Callable[[bytes, np.ndarray], tuple],
    result: list[tuple[str, str]],
) -> DataFrame:
    """did, uid and the result columns of every row of ``texts`` (did, text, uid).

    ``compare`` takes Arrow batches of blocks, whole grams each, and yields
    (uid, first, count) of windows that occur earlier in another block.
    ``finish`` makes a row's result from its text and its removed runs, an
    array of (first window, windows).
    """
    runs = texts.mapInArrow(run_rows(unit, False), RUNS_SQL)
    marks = by_document(classified(runs, False), "gram", "open")
    columns = ", ".join(f"{n} {t}" for n, t in result)
    names = [n for n, _ in result]

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            rows = []
            listed = batch.column(batch.schema.get_field_index("marks"))
            place = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy(zero_copy_only=False))])
            flat = listed.flatten()
            first, count, gram, is_open = (np.asarray(flat.field(i)) for i in range(4))
            did, uid = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("did", "uid"))
            for i, text in enumerate(common.texts_of(batch)):
                cut = slice(place[i], place[i + 1])
                mine = is_open[cut]
                removed = np.stack([first[cut][~mine], count[cut][~mine]], axis=1).astype(np.int64)
                row = {"did": did[i], "uid": uid[i]}
                if mine.any():
                    row |= {
                        "text": text.decode(),
                        "removed": removed.tobytes(),
                        "open": np.stack([gram[cut][mine], first[cut][mine], count[cut][mine]], axis=1).astype(np.int64).tobytes(),
                    }
                else:
                    row |= dict(zip(names, finish(text, removed), strict=True))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=decided_schema)

    decided_sql = f"did long, uid long, {columns}, text string, removed binary, open binary"
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    decided_schema = pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in decided_sql.split(", ")])
    table = common.settle(texts.join(marks, "uid", "left").mapInArrow(decided, decided_sql), "decided")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            opens = batch.column(batch.schema.get_field_index("open")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("uid")).to_pylist()
            for uid, text, told in zip(ids, common.texts_of(batch), opens, strict=True):
                yield block_rows(unit, uid, text, np.frombuffer(told, dtype=np.int64).reshape(-1, 3))

    pending = table.where("open is not null")
    sent = pending.select("uid", "text", "open").mapInArrow(blocks, BLOCKS_SQL)
    found = sent.repartition("gram").sortWithinPartitions("gram").mapInArrow(whole_grams(compare), FOUND_SQL)
    more = by_document(found)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("did", pa.int64()), ("uid", pa.int64()), *((n, arrow[t]) for n, t in result)])
        for batch in common.batches_of(batches):
            rows = []
            marks = batch.column(batch.schema.get_field_index("marks")).to_pylist()
            known = batch.column(batch.schema.get_field_index("removed")).to_pylist()
            did, uid = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("did", "uid"))
            for i, text in enumerate(common.texts_of(batch)):
                late = np.array([(m["first"], m["count"]) for m in marks[i] or []], dtype=np.int64).reshape(-1, 2)
                removed = np.concatenate([np.frombuffer(known[i], dtype=np.int64).reshape(-1, 2), late])
                rows.append({"did": did[i], "uid": uid[i]} | dict(zip(names, finish(text, removed), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    late = pending.select("did", "uid", "text", "removed").join(more, "uid", "left").mapInArrow(finished, f"did long, uid long, {columns}")
    return table.where("open is null").select("did", "uid", *names).unionByName(late)


def block_rows(unit: Unit, uid: int, text: bytes, opens: np.ndarray) -> pa.RecordBatch:
    """The symbols of open runs: raw bytes, from the first symbol to the last."""
    gram, first, count = opens.T
    last = first + count - 1 + unit.window
    if unit.words:
        words = spans.split_words([text], lower=False)
        starts, ends = words.starts[first], words.ends[last - 1]
    else:
        starts, ends = first, last
    symbols = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    ids = np.full(len(gram), uid, dtype=np.int64)
    return common.pack(BLOCKS, gram, ids, first.astype(np.int32), count.astype(np.int32), symbols)


def whole_grams(compare: Callable) -> Callable:
    """Feed sorted rows to ``compare`` in pieces that never part a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < COMPARED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            grams = np.asarray(table.column("gram"))
            cut = int(np.searchsorted(grams, grams[-1]))
            if cut:
                yield from compare(table.slice(0, cut))
            held, size = table.slice(cut).combine_chunks().to_batches(), table.slice(cut).nbytes
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return run


def later(group: np.ndarray, uid: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Indices of rows that are not the earliest of their group.

    Rows equal to the earliest in document and place are the same document again.
    """
    order = np.lexsort((begin, uid, group))
    g, u, b = group[order], uid[order], begin[order]
    head = np.concatenate([[True], g[1:] != g[:-1]])
    at = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0)) if len(g) else order
    return order[(u != u[at]) | (b != b[at])]


def covered(removed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches [start, end) of symbols under the removed windows."""
    if not len(removed):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    none = np.zeros(len(removed), dtype=np.int64)
    _, first, count = merged(none, removed[:, 0], removed[:, 1] + window - 1)
    return first, first + count
