"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

Texts are UTF-8 bytes. Runs of windows that share an anchor with other
surroundings (see ``repeats``) meet in one task, gram by gram. There their
suffixes are sorted into a suffix array, as far as a run reaches, with the
length of the common prefix (LCP) of neighbours. A stack scan over the LCPs
visits the nodes of the interval tree from the leaves up: a node of depth L
is a string of L bytes, and its interval lists all its occurrences. A node is a
maximal repeat if it can't be extended: not to the right, as that is a deeper
node, and not to the left, as its occurrences follow different bytes. The
first occurrence of each maximal repeat stays and all others are removed.

Why that removes the right bytes: a repeated window's longest common extension
with an earlier place is a maximal repeat, which covers it; and every byte of a
later occurrence of a repeat of at least ``window`` bytes lies in a window
that starts earlier. The ends of a run count as different bytes.

Defined results: null and empty texts have no bytes and the digest of the empty
text; a text shorter than the window is left alone; rows equal in doc_id and
text are one document and get equal results; documents of equal doc_id and
other texts are ordered by a hash of the text; a null doc_id sorts first. Cuts
may fall within a character: digests are of bytes, and texts are decoded with
broken characters left out (``kept_text``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common, repeats, spans

GRAM = 32
WORD = 8


def word_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number that sorts like them."""
    out = np.zeros(len(places), dtype=np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | data[places + k]
    return out


def all_words(data: np.ndarray) -> np.ndarray:
    """``word_at`` of every place; data ends in ``WORD`` bytes of padding."""
    out = np.zeros(len(data) - WORD, dtype=np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(8)) | data[k : len(data) - WORD + k]
    return out


def suffix_array(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``starts``, each ``sizes`` bytes long, by their bytes.

    Ties are refined eight bytes at a time. A suffix that has ended leaves its
    group by its size, so all within a group are compared by real bytes only.
    """
    order = np.argsort(words[starts], kind="stable")
    group = words[starts][order]
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]), dtype=np.int32)
    del group
    depth = WORD
    while True:
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = rank[1:] == rank[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        at = at[sizes[order[at]] > depth] if len(at) else at
        if not len(at):
            return order
        # within a tie, those that have ended come first
        at = np.flatnonzero(tied)
        mine = order[at]
        more = sizes[mine] > depth
        key = np.where(more, words[np.where(more, starts[mine] + depth, 0)], 0)
        ended = np.where(more, 1, 0)
        refined = np.lexsort((key, ended, rank[at]))
        order[at] = mine[refined]
        key, ended, old = key[refined], ended[refined], rank[at][refined]
        new = np.concatenate([[False], (key[1:] != key[:-1]) | (ended[1:] != ended[:-1]) | (old[1:] != old[:-1])])
        bump = np.zeros(len(order), dtype=np.int32)
        bump[at] = new & np.concatenate([[False], at[1:] == at[:-1] + 1])
        bump[1:] |= rank[1:] != rank[:-1]
        # ended suffixes of one tie are equal: they must not be looked at again
        still = ended == 0
        rank = np.cumsum(bump, dtype=np.int32)
        if still.any() and not more.any():
            return order
        depth += WORD


def common_prefixes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it; the first has 0."""
    n = len(order)
    lcp = np.zeros(n, dtype=np.int32)
    a, b = order[:-1], order[1:]
    limit = np.minimum(sizes[a], sizes[b])
    active, depth = np.arange(n - 1), 0
    while len(active):
        x, y = words[starts[a[active]] + depth], words[starts[b[active]] + depth]
        differ = x ^ y
        whole = differ == 0
        ended = active[~whole]
        if len(ended):
            bits = differ[~whole]
            # place of the highest differing bit, from halves that floats hold exactly
            high = (bits >> np.uint64(32)).astype(np.float64)
            low = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64)
            top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
            lcp[ended + 1] = np.minimum(depth + (64 - top) // 8, limit[ended])
        active = active[whole]
        depth += WORD
        full = limit[active] <= depth
        lcp[active[full] + 1] = limit[active[full]]
        active = active[~full]
    return lcp


def intervals(lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the left-diverse nodes of depth ``least`` or more.

    One scan with a stack of open nodes. Each carries the byte that all its
    suffixes follow, or -1 once two differ; -1 in ``left`` stands for no byte and
    differs from everything.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []  # depth, first, byte
    n = len(left)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            if top[2] != byte:
                top[2] = -1
            if top[2] == -1:
                out.append((top[0], top[1], i - 1))
            first, byte = top[1], top[2]
        if depth >= least:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != byte:
                    stack[-1][2] = -1
            else:
                stack.append([depth, first, byte])
    return out


def maximal_repeats(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, length, block, offset) of every occurrence of every maximal repeat of the blocks."""
    symbols = table.column("symbols").to_pylist()
    count = np.asarray(table.column("count")).astype(np.int64)
    data, bounds = spans.join_texts(symbols, gap=1)
    data = np.concatenate([data, np.zeros(256, dtype=np.uint8)])
    words = all_words(data)
    heads = bounds[:-1]
    lengths = np.diff(bounds) - 1
    # places in a piece fit into 32 bits
    block = np.repeat(np.arange(len(symbols), dtype=np.int32), count)
    offset = np.arange(count.sum(), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    starts, sizes = heads.astype(np.int32)[block] + offset, lengths.astype(np.int32)[block] - offset
    order = suffix_array(words, starts, sizes).astype(np.int32)
    lcp = common_prefixes(words, starts, sizes, order)
    del words, sizes
    block, offset, starts = block[order], offset[order], starts[order]
    # stretches of neighbours that share a window; those that all follow one byte hold no maximal repeat
    long = lcp >= window
    head = ~long
    at = np.flatnonzero(head)
    ends = np.concatenate([at[1:], [len(lcp)]])
    left = np.where(offset == 0, -1, data[np.maximum(starts - 1, 0)].astype(np.int32))
    low, high = np.minimum.reduceat(left, at), np.maximum.reduceat(left, at)
    wanted = (ends - at > 1) & ((low != high) | (low < 0))
    groups, depths, members = [], [], []
    n = 0
    for a, b in zip(at[wanted].tolist(), ends[wanted].tolist(), strict=True):
        for depth, first, last in intervals(lcp[a:b].tolist(), left[a:b].tolist(), window):
            members.append(np.arange(a + first, a + last + 1))
            groups.append(np.full(last - first + 1, n))
            depths.append(np.full(last - first + 1, depth))
            n += 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    members = np.concatenate(members)
    return np.concatenate(groups), np.concatenate(depths), block[members], offset[members].astype(np.int64)


def remove_later(window: int):
    """A comparison for ``repeats.find``."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, depth, block, offset = maximal_repeats(table, window)
        if not len(group):
            return
        uid = np.asarray(table.column("uid"))[block]
        begin = np.asarray(table.column("first")).astype(np.int64)[block] + offset
        again = repeats.later(group, uid, begin)
        if len(again):
            ids, first, count = repeats.merged(uid[again], begin[again], depth[again].astype(np.int64) - window + 1)
            yield common.pack(repeats.FOUND, ids, first.astype(np.int32), count.astype(np.int32))

    return compare


def kept_bytes(text: bytes, removed: np.ndarray, window: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of stretches removed."""
    starts, ends = repeats.covered(removed, window)
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), len(starts)


def deduplicate(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def finish(text: bytes, removed: np.ndarray) -> tuple[int, int, int, str]:
        kept, stretches = kept_bytes(text, removed, window)
        return len(text), len(text) - len(kept), stretches, hashlib.sha256(kept).hexdigest()

    result = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    rows = repeats.find(repeats.unique_ids(docs), unit(window), remove_later(window), finish, result)
    return rows.select(common.restore_id(), *(n for n, _ in result))


def kept_texts(docs: DataFrame, window: int = 100) -> DataFrame:
    """(uid, kept): each document's text without its repeats, by ``repeats.unique_ids``."""

    def finish(text: bytes, removed: np.ndarray) -> tuple[str]:
        return (kept_bytes(text, removed, window)[0].decode("utf-8", "ignore"),)

    found = repeats.find(repeats.unique_ids(docs), unit(window), remove_later(window), finish, [("kept", "string")])
    found = found.select("uid", "kept")
    return found.dropDuplicates(["uid"]) if repeats.ids_repeat(docs) else found


def with_kept_texts(docs: DataFrame, window: int = 100) -> DataFrame:
    """``documents`` rows (doc_id, text, lang, source, n_chars) with the repeats cut out of their texts."""
    rows = repeats.unique_ids(docs, "lang", "source").select("did", "uid", "lang", "source")
    return rows.join(kept_texts(docs, window), "uid").select(
        common.restore_id(), F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars")
    )


def unit(window: int) -> repeats.Unit:
    return repeats.Unit(words=False, window=window, gram=min(GRAM, window))


def repeat_groups(docs: DataFrame, window: int = 100) -> DataFrame:
    """Every occurrence of every maximal repeat: group, bytes, doc_id, start.

    Repeats are told as far as the runs of an anchor reach (``window`` bytes and what its
    windows span); longer ones appear as overlapping groups. Runs that are equal
    are all sent to the comparison here, so every occurrence is listed.
    """
    texts = repeats.unique_ids(docs)
    own = unit(window)
    runs = repeats.classified(texts.mapInArrow(repeats.run_rows(own, True), repeats.RUNS_SQL), True)
    marks = repeats.by_document(runs.distinct(), "gram")
    schema = pa.schema([("group", pa.string()), ("bytes", pa.int64()), ("uid", pa.int64()), ("start", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            marks = batch.column(batch.schema.get_field_index("marks")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("uid")).to_pylist()
            for uid, text, told in zip(ids, common.texts_of(batch), marks, strict=True):
                yield repeats.block_rows(own, uid, text, np.array([(m["gram"], m["first"], m["count"]) for m in told]))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, depth, block, offset = maximal_repeats(table, window)
        if not len(group):
            return
        symbols = table.column("symbols").to_pylist()
        names = [hashlib.sha256(symbols[b][o : o + d]).hexdigest() for b, o, d in zip(block.tolist(), offset.tolist(), depth.tolist(), strict=True)]
        uid = np.asarray(table.column("uid"))[block]
        start = np.asarray(table.column("first")).astype(np.int64)[block] + offset
        yield common.pack(schema, names, depth, uid, start)

    one = texts.dropDuplicates(["uid"])
    sent = one.select("uid", "text", "did").join(marks, "uid").mapInArrow(blocks, repeats.BLOCKS_SQL)
    found = sent.repartition("gram").sortWithinPartitions("gram")
    found = found.mapInArrow(repeats.whole_grams(compare), "group string, bytes long, uid long, start long")
    ids = one.select("uid", "did")
    return found.join(ids, "uid").select("group", "bytes", common.restore_id(), "start").distinct()
