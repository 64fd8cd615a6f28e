"""Benchmark decontamination by q-gram counts in diagonal bands.

Texts are compared in a plain form: A-Z lower-cased, runs of ASCII white space
as one blank. A region of a document matches a benchmark item of n bytes if at
most ``k = n * errors // 100`` single-byte edits turn one into the other. By
the q-gram lemma such a region shares at least ``n - q + 1 - k * q`` q-grams
with the item, on diagonals (place in the document minus place in the item)
that differ by k at most. So

* every q-gram of a document that occurs in an item is a hit on a diagonal;
* hits are counted in bands of 2 (k + 1) diagonals that overlap by half, so
  any k + 1 neighbouring diagonals lie within one band;
* bands with enough hits are verified by banded alignment, which finds the
  least number of edits and where the region ends.

q-grams that many items share would give most hits and least evidence. From
every item, the commonest (by items they occur in) are set aside, up to half the
bound, and the bound for the others is lowered by as many: still a lower bound,
so nothing is lost.

Documents are read once per block of items (``block_bytes``), an index of
bounded size sent along with the tasks, without a shuffle.

An item shorter than ``shortest`` bytes in plain form leaves no room for edits:
it is looked up verbatim, standing between word bounds, all such items of a
block at once.

Defined results: null and empty texts and items match nothing; an item of fewer
than ``least_words`` words (1 in ``find``; 3 in ``clean``, as a word or two stand in
clean documents too) is left out; a budget is lowered until the q-gram bound is 2 at least (short items allow
fewer edits); rows repeated in either table give rows for each; a
null item_id or doc_id stays null. Of regions that overlap, only the best is
reported.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

Q = 8
BITS = 22
# A-Z become lower case, white space a blank
_PLAIN = bytes(
    32 if b in range(0x09, 0x0E) else b + 32 if b in range(0x41, 0x5B) else b for b in range(256)
)
_BLANKS = re.compile(rb"  +")

REGIONS = pa.schema(
    [("row", pa.int32()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_bytes", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
)


def plain(text: bytes) -> bytes:
    form = text.translate(_PLAIN).strip(b" ")
    return _BLANKS.sub(b" ", form) if b"  " in form else form


def grams(data: np.ndarray) -> np.ndarray:
    """Each run of 8 bytes as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for shift in range(Q):
        part = data[shift : shift + (len(data) - shift) // Q * Q].view("<u8")
        out[shift::Q] = part[: len(range(shift, n, Q))]
    return out


def slots(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def in_word(byte: int) -> bool:
    """0-9, a-z and all of a letter beyond ASCII."""
    return 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80


def stands_alone(text: bytes, start: int, end: int) -> bool:
    """True unless a word goes on across an edge of the region."""
    before = start > 0 and in_word(text[start - 1]) and in_word(text[start])
    after = end < len(text) and in_word(text[end - 1]) and in_word(text[end])
    return not before and not after


def edit_budget(n: int, errors: int) -> int:
    """Edits allowed for an item of n bytes; the q-gram bound stays at 2 or more."""
    return max(0, min(n * errors // 100, (n - Q - 1) // Q))


class Index:
    """q-grams of a block of items; those below ``shortest`` bytes are kept as they are."""

    def __init__(self, items: list[tuple[int | None, bytes]], errors: int, shortest: int = Q + 1):
        shortest = max(shortest, Q + 1)
        ordered = sorted(items, key=lambda item: len(item[1]) < shortest)  # stable: the long ones first
        self.ids = [i for i, _ in ordered]
        self.texts = [t for _, t in ordered]
        long = [t for t in self.texts if len(t) >= shortest]
        self.long = len(long)
        if not long:
            return
        self.size = np.array([len(t) for t in long], dtype=np.int64)
        self.budget = np.array([edit_budget(len(t), errors) for t in long], dtype=np.int64)
        bound = self.size - Q + 1 - self.budget * Q
        every = [grams(np.frombuffer(t, dtype=np.uint8)) for t in long]
        seen, counts = np.unique(np.concatenate([np.unique(g) for g in every]), return_counts=True)
        values, owners, places = [], [], []
        self.need = np.zeros(len(long), dtype=np.int64)
        for k, own in enumerate(every):
            common_first = np.argsort(-counts[np.searchsorted(seen, own)], kind="stable")
            spare = int(bound[k] // 2)
            # those that no other item has are the best evidence: never set aside
            aside = [i for i in common_first[:spare] if counts[np.searchsorted(seen, own[i])] > 1]
            self.need[k] = bound[k] - len(aside)
            kept = np.setdiff1d(np.arange(len(own)), aside)
            values.append(own[kept])
            owners.append(np.full(len(kept), k))
            places.append(kept)
        values = np.concatenate(values)
        order = np.argsort(values, kind="stable")
        self.owners, self.places = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.values, self.first, self.many = np.unique(values[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << BITS, dtype=bool)
        self.filter[slots(self.values)] = True

    @functools.cached_property
    def verbatim(self) -> ahocorasick.Automaton:
        """Finds all short items in one pass; a byte stands for a character."""
        owners: dict[bytes, list[int]] = {}
        for item in range(self.long, len(self.texts)):
            owners.setdefault(self.texts[item], []).append(item)
        found = ahocorasick.Automaton()
        for form, of in owners.items():
            found.add_word(form.decode("latin-1"), (len(form), of))
        found.make_automaton()
        return found

    def whole(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of every short item that stands between word bounds."""
        if self.long == len(self.texts):
            return
        for last, (size, of) in self.verbatim.iter(text.decode("latin-1")):
            if stands_alone(text, last + 1 - size, last + 1):
                for item in of:
                    yield item, last + 1 - size, last + 1

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in data, item, place in item) of every shared q-gram."""
        found = grams(data)
        at = np.flatnonzero(self.filter[slots(found)])
        values = found[at]
        slot = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        exact = self.values[slot] == values
        at, slot = at[exact], slot[exact]
        many = self.many[slot]
        entry = np.repeat(self.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.owners[entry], self.places[entry]

    def bands(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first diagonal) of the bands that reach the bound."""
        at, item, place = self.hits(data)
        text = np.searchsorted(bounds, at, side="right") - 1
        half = self.budget[item] + 1
        # diagonals are counted within the text, from the item's length on, so that they are positive
        diagonal = at - bounds[text] - place + self.size[item]
        step = diagonal // half
        rows = []
        for back in (0, 1):
            band = step - back
            key = np.stack([text, item, band], axis=1)
            rows.append(key)
        keys = np.concatenate(rows)
        places = np.concatenate([place, place])
        packed = (keys[:, 0] * len(self.ids) + keys[:, 1]) * (1 << 32) + (keys[:, 2] + 1)
        many, inverse = np.unique(packed, return_inverse=True)
        total = np.bincount(inverse, minlength=len(many))
        owner = (many >> 32) % len(self.ids)
        likely = np.flatnonzero(total >= self.need[owner])
        # a q-gram of the item counts once, however often the band repeats it
        mine = np.isin(inverse, likely)
        distinct = np.unique(np.stack([inverse[mine], places[mine]], axis=1), axis=0)[:, 0]
        total = np.bincount(distinct, minlength=len(many))
        passed = np.flatnonzero(total >= self.need[owner])
        item = owner[passed]
        return (many[passed] >> 32) // len(self.ids), item, ((many[passed] & 0xFFFFFFFF) - 1) * (self.budget[item] + 1) - self.size[item]

    def verify(self, text: bytes, item: int, first: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best region of a band, or None beyond the budget."""
        goal, k = self.texts[item], int(self.budget[item])
        from_, to = max(0, first - k), min(len(text), first + 2 * (k + 1) + len(goal) + k)
        exact = text.find(goal, from_, to)
        if exact >= 0:
            return 0, exact, exact + len(goal)
        found = align(goal, text[from_:to], first - from_ - k, 2 * (k + 1) + 2 * k)
        if found is None or found[0] > k:
            return None
        return found[0], from_ + found[1], from_ + found[2]


def align(goal: bytes, text: bytes, first: int, width: int) -> tuple[int, int, int] | None:
    """Least edits between all of ``goal`` and any region of ``text`` on diagonals first to first + width.

    Row i holds the cells (i, i + diagonal). Within a row, insertions run to
    the right, which a running minimum of cost minus place resolves at once.
    """
    far = 1 << 20
    diagonals = np.arange(first, first + width + 1)
    letters = np.frombuffer(text, dtype=np.uint8)
    place = np.arange(width + 1)
    valid = (diagonals >= 0) & (diagonals <= len(text))
    cost = np.where(valid, 0, far)
    start = diagonals.copy()
    for i, letter in enumerate(goal, 1):
        columns = diagonals + i
        inside = (columns >= 1) & (columns <= len(text))
        differs = np.ones(width + 1, dtype=np.int64)
        differs[inside] = letters[columns[inside] - 1] != letter
        swap = np.where(inside, cost + differs, far)
        skip = np.append(cost[1:] + 1, far)
        skip[(columns < 0) | (columns > len(text))] = far
        best = np.minimum(swap, skip)
        origin = np.where(swap <= skip, start, np.append(start[1:], 0))
        lead = best - place
        run = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == run, place, 0))
        cost = np.where((columns >= 0) & (columns <= len(text)), run + place, far)
        start = origin[source]
    end = int(np.argmin(cost))
    if cost[end] >= far:
        return None
    return int(cost[end]), int(start[end]), int(diagonals[end] + len(goal))


def regions(index: Index, texts: list[bytes]) -> list[tuple[int, int | None, int, int, int, int]]:
    """(row, item_id, edits, item bytes, start, end) of all regions, places in plain form."""
    forms = [plain(t) for t in texts]
    gap = b"\x00" * Q
    data = np.frombuffer(gap.join(forms) + gap, dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + Q for t in forms])])
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    bands = zip(*(x.tolist() for x in index.bands(data, bounds)), strict=True) if index.long else ()
    for text, item, first in bands:
        region = index.verify(forms[text], item, first)
        if region is not None:
            found.setdefault((text, item), []).append(region)
    for text, form in enumerate(forms):
        for item, start, end in index.whole(form):
            found.setdefault((text, item), []).append((0, start, end))
    out = []
    for (text, item), all_of in found.items():
        kept: list[tuple[int, int, int]] = []
        for region in sorted(set(all_of)):
            # a short item may occur as often as the text is long, in order: the last one is all it can overlap
            others = kept[-1:] if item >= index.long else kept
            if all(region[2] <= x[1] or region[1] >= x[2] for x in others):
                kept.append(region)
        out += [(text, index.ids[item], e, len(index.texts[item]), a, b) for e, a, b in kept]
    return sorted(out, key=lambda r: (r[0], r[4], r[1] is not None, r[1]))


def item_blocks(benchmark: DataFrame, least_words: int, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in plain form, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        form = plain((text or "").encode())
        if not form or form.count(b" ") + 1 < least_words:
            continue
        if block and size + len(form) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, form))
        size += len(form)
    if block:
        yield block


def find(
    docs: DataFrame, benchmark: DataFrame, *, errors: int = 10, shortest: int = 32, least_words: int = 1, block_bytes: int = 4 << 20
) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start, end) of every region that matches an item.

    start and end are byte places in the document's plain form; similarity is
    1 - edits / item bytes. The table has no rows for clean documents.
    """
    texts = common.whole_texts(docs)
    schema = "did long, item_id long, edits int, item_bytes int, start long, end long"
    names = [f.strip().split()[0] for f in schema.split(",")]
    parts = []
    for block in item_blocks(benchmark, least_words, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, errors, shortest))

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.batches_of(batches):
                rows = regions(sent.value, common.texts_of(batch))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    found = common.pack(REGIONS, *map(list, columns))
                    dids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                    yield pa.RecordBatch.from_arrays([dids, *found.columns[1:]], names=names)

        parts.append(texts.mapInArrow(searched, schema))
    if not parts:
        parts = [texts.limit(0).select("did", *(F.lit(None).cast(t).alias(n) for n, t in [("item_id", "long"), ("edits", "int"), ("item_bytes", "int"), ("start", "long"), ("end", "long")]))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        common.restore_id(), "item_id", "edits", (1 - F.col("edits") / F.col("item_bytes")).alias("similarity"), "start", "end"
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, *, errors: int = 10, shortest: int = 32, least_words: int = 3, block_bytes: int = 4 << 20
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no region matching an item."""
    for block in item_blocks(benchmark, least_words, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, errors, shortest))

        def kept(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.batches_of(batches):
                found = {r[0] for r in regions(sent.value, common.texts_of(batch))}
                yield batch.filter(pa.array([i not in found for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
