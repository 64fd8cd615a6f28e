"""Substring dedup by seed and extend, on words.

Documents are joined on winnowed anchors (seeds, see ``repeats``). Under an
anchor the runs of all documents are laid over one another at the anchor and
extended both ways, a word at a time: runs that agree on i words to the left
and j words to the right of the anchor are in one class. A placement with
i + anchor + j words in a window is a repeat if its two classes are shared, and
all but its first occurrence are removed. Neighbouring windows merge into
maximal repeats. No pair of documents is ever written out.

Defined results: null and empty texts have no words and the digest of the empty
text; rows equal in doc_id and text are one document and get equal results;
documents of equal doc_id and other texts are ordered by a hash of the text; a
null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm import common, repeats, spans

GRAM = 6


def classes(previous: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Class of each row by its class so far and its next word."""
    order = np.lexsort((words, previous))
    a, b = previous[order], words[order]
    new = np.concatenate([[0], ((a[1:] != a[:-1]) | (b[1:] != b[:-1])).astype(np.int64)])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def extend(window: int):
    """A comparison for ``repeats.find``."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, uid, first, count = (np.asarray(table.column(n)) for n in ("gram", "uid", "first", "count"))
        words = spans.split_words(table.column("symbols").to_pylist(), lower=False)
        starts, sizes = words.bounds[:-1], np.diff(words.bounds)
        rolling = spans.Rolling(words.codes)
        # place of the seed in each run: the gram whose hash named it, in reach of all windows
        hashes = rolling.windows(GRAM)
        seed = np.full(len(gram), -1, dtype=np.int64)
        for offset in range(window - GRAM, -1, -1):
            at = starts + offset
            fits = (offset >= count - 1) & (offset + GRAM <= sizes)
            here = np.zeros(len(gram), dtype=bool)
            here[fits] = hashes[at[fits]].view(np.int64) == gram[fits]
            seed[here] = offset
        if (seed < 0).any():
            raise ValueError("a run without its anchor")
        seed += starts
        ends = starts + sizes
        reach = window - GRAM
        alone = -np.arange(1, len(gram) + 1)  # beyond a run's end nothing agrees
        codes = words.codes.view(np.int64)

        def word(places: np.ndarray, inside: np.ndarray) -> np.ndarray:
            return np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], alone)

        seeds = classes(np.zeros(len(gram), dtype=np.int64), gram)
        left, right = [seeds], [seeds]
        for k in range(1, reach + 1):
            left.append(classes(left[-1], word(seed - k, seed - k >= starts)))
            at = seed + GRAM + k - 1
            right.append(classes(right[-1], word(at, at < ends)))
        out = []
        for k in range(reach + 1):
            # the window that has k words before the seed
            offset = seed - starts - k
            rows = np.flatnonzero((offset >= 0) & (offset < count))
            both = classes(left[k][rows], right[reach - k][rows])
            begin = first[rows] + offset[rows]
            picked = repeats.later(both, uid[rows], begin)
            out.append((uid[rows][picked], begin[picked]))
        ids, begins = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(ids):
            ids, begins, counts = repeats.merged(ids, begins, np.ones(len(ids), dtype=np.int64))
            yield common.pack(repeats.FOUND, ids, begins.astype(np.int32), counts.astype(np.int32))

    return compare


def kept_words(window: int):
    """Result of one document: words, words removed, digest of the rest."""

    def finish(text: bytes, removed: np.ndarray) -> tuple[int, int, str]:
        if not len(removed):
            words = text.split()
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        words = text.split()
        starts, ends = repeats.covered(removed, window)
        kept: list[bytes] = []
        at = 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return finish


def deduplicate(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    result = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
    unit = repeats.Unit(words=True, window=window, gram=GRAM)
    rows = repeats.find(repeats.unique_ids(docs), unit, extend(window), kept_words(window), result)
    return rows.select(common.restore_id(), *(n for n, _ in result))
