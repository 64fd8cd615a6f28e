"""BPE encoding of whole texts by tree concatenation, and decoding.

Byte-level BPE first cuts a text into pieces by a pattern, then merges bytes
within each piece. Two facts give exact parallel encoding:

* No piece of the pattern goes on from a character that is no white space to
  one that is. So a text may be cut before any blank that follows a
  non-blank, and the parts' tokens joined as they are.
* Where a long stretch has no such place, its halves are encoded by themselves
  and joined: a window of tokens around the join is encoded anew, and grows
  until it begins with tokens that the left half ends on and ends with
  tokens that the right half begins with, far enough from the join on both
  sides. The join then keeps the left half's tokens, the window's middle and
  the right half's.

Texts longer than ``split_chars`` are cut into rows, encoded by many tasks and
joined pairwise in rounds, a tree over the parts; each round halves their
number. Everything else is encoded where it is read, without a shuffle.

Defined results: null and empty texts have no tokens; the text of a special
token becomes that token; repeated rows and rows with a null doc_id are
encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common

# The pattern that cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# a blank after white space
UNSAFE = re.compile(r"\s ")

# longest stretch without a safe cut that is encoded in one go, in characters
WHOLE = 4096
# stretches kept encoded per worker; a memory bound only
REMEMBERED = 100_000
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for U+0100 onwards.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Ids of short stretches met before, up to a number that only bounds memory."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = tuple(self.encode(text))
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        if told["normalizer"] is not None or told["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalisation is supported")
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in told["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {b: i for i, b in self.bytes_of.items() if i not in special.values()}
        # merging takes the lowest rank first, and ids rise with the rank of the merge that makes them
        self.merging = tiktoken.Encoding("pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.digits = {i: str(i) for i in self.bytes_of}
        self.first = Remembered(self.tree)
        self.after = Remembered(lambda word: self.tree(" " + word))

    def encode(self, text: str) -> list[int]:
        if self.cut_special is None or not any(t in text for t in self.special):
            return self.encode_plain(text)
        out: list[int] = []
        for i, part in enumerate(self.cut_special.split(text)):
            out += [self.special[part]] if i % 2 else self.encode_plain(part)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens: in one go, or cut at its blanks if a stretch is longer than ``WHOLE``."""
        if not text:
            return []
        words = text.split(" ")
        if UNSAFE.search(text) is None:
            if max(map(len, words)) < WHOLE:
                return self.merging.encode_ordinary(text)
            ids = list(self.first[words[0]]) if words[0] else []
            ids.extend(chain.from_iterable(map(self.after.__getitem__, words[1:])))
            return ids
        # a blank after a blank or other white space is no safe cut
        stretches: list[str] = []
        held = words[0]
        for word in words[1:]:
            if not held or held[-1].isspace():
                held += " " + word
            else:
                stretches.append(held)
                held = " " + word
        stretches.append(held)
        if max(map(len, stretches)) <= WHOLE:
            return self.merging.encode_ordinary(text)
        return list(chain.from_iterable(map(self.first.__getitem__, stretches)))

    def tree(self, text: str) -> list[int]:
        """Ids of one stretch: whole if short, else its halves joined."""
        if len(text) <= WHOLE:
            return self.merging.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined text from the ids of its two sides.

        The window's first and last tokens are trusted only beyond a margin: a
        piece may begin before the window, and a lookahead may reach past it.
        """
        reach = 32
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            a, b = self.whole_characters(left, right, a, b)
            window = self.merging.encode_ordinary(self.text_of(left[a:] + right[:b]))
            margin = reach // 4
            head = self.agreeing(window, left[a:], 0 if a == 0 else margin)
            tail = self.agreeing(window[::-1], right[:b][::-1], 0 if b == len(right) else margin)
            if head is not None and tail is not None:
                if a == 0 and b == len(right):
                    return window
                if head + tail <= len(window):
                    return left[: a + head] + window[head : len(window) - tail] + right[b - tail :]
            elif a == 0 and b == len(right):
                return window
            reach *= 2

    @staticmethod
    def agreeing(window: list[int], side: list[int], margin: int) -> int | None:
        """Number of leading tokens in common if it is ``margin`` at least; 0 suffices without a margin."""
        if margin == 0:
            return 0
        n = 0
        for x, y in zip(window, side, strict=False):
            if x != y:
                break
            n += 1
        return n if n >= margin else None

    def whole_characters(self, left: list[int], right: list[int], a: int, b: int) -> tuple[int, int]:
        """Widen a window so that it begins and ends between characters."""
        while a > 0 and self.bytes_of[left[a]][0] & 0xC0 == 0x80:
            a -= 1
        while b < len(right) and self.bytes_of[right[b]][0] & 0xC0 == 0x80:
            b += 1
        return a, b

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def text_of(self, ids: list[int]) -> str:
        """Decoded text; bytes that are no UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    return Codec(path)


ENCODED = pa.schema([("row", pa.int64()), ("did", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema(
    [("did", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def digest_row(own: Codec, ids: list[int], with_ids: bool) -> tuple[list[int] | None, int, str, str]:
    return (
        ids if with_ids else None,
        len(ids),
        hashlib.sha256(own.listed(ids).encode()).hexdigest(),
        hashlib.sha256(own.text_of(ids).encode()).hexdigest(),
    )


def cut_parts(text: str, size: int, specials: list[str]) -> list[str]:
    """Parts of about ``size`` characters; a special token's text is never cut."""
    ends, at = [], size
    while at < len(text):
        for token in specials:
            found = text.find(token, max(0, at - len(token) + 1), at + len(token) - 1)
            if found >= 0:
                at = found + len(token)
        ends.append(at)
        at += size
    starts = [0, *ends]
    return [text[a:b] for a, b in zip(starts, [*ends, len(text)], strict=True) if a < b]


def long_parts(docs: DataFrame, path: str, split_chars: int) -> DataFrame:
    """Encoded parts of the texts that are longer than ``split_chars``, each row with its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = list(codec(path).special)
        for batch in batches:
            for row in batch.to_pylist():
                for k, part in enumerate(parts := cut_parts(row["text"], split_chars, specials)):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row["row"], "did": row["did"], "part": k, "parts": len(parts), "text": part}]
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            yield common.pack(ENCODED, *columns, [own.encode(t) for t in batch.column(4).to_pylist()])

    # each long row gets a number of its own; written out, as it must not change when a task is run again
    rows = docs.where(F.char_length("text") > split_chars).withColumn("row", F.monotonically_increasing_id())
    rows = common.settle(rows.select("row", "did", "text"), "long")
    parts = rows.mapInArrow(cut, "row long, did long, part long, parts long, text string")
    return parts.repartition("row", "part").mapInArrow(encoded, "row long, did long, part long, parts long, ids array<int>")


def join_round(parts: DataFrame, path: str) -> DataFrame:
    """Join parts 2k and 2k + 1 of every text."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        sides = table.column("ids").to_pylist()
        own = codec(path)
        first = table.slice(0, 1).to_pylist()[0]
        ids = sides[0] if len(sides) == 1 else join_ids(own, sides[0], sides[1])
        out = {"row": first["row"], "did": first["did"], "part": first["part"] // 2, "parts": (first["parts"] + 1) // 2, "ids": ids}
        return pa.Table.from_pylist([out], schema=ENCODED)

    pair = F.floor(F.col("part") / 2).alias("pair")
    return parts.groupBy("row", pair).applyInArrow(joined, "row long, did long, part long, parts long, ids array<int>")


def join_ids(own: Codec, left: list[int], right: list[int]) -> list[int]:
    """Join two sides that may hold special tokens: those are cuts already."""
    ends = [i for i, t in enumerate(left) if t in own.special.values()]
    begins = [i for i, t in enumerate(right) if t in own.special.values()]
    a = ends[-1] + 1 if ends else 0
    b = begins[0] if begins else len(right)
    if a == len(left) or b == 0:
        return left + right
    return left[:a] + own.join(left[a:], right[:b]) + right[b:]


def encode(docs: DataFrame, path: str, *, split_chars: int = 1 << 16, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every document's whole text; ids are null if not asked for."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.batches_of(batches):
            rows = [digest_row(own, own.encode(t), with_ids) for t in batch.column(1).to_pylist()]
            yield common.pack(DIGESTS, batch.column(0), *map(list, zip(*rows, strict=True)))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for did, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield common.pack(DIGESTS, *([x] for x in (did, *digest_row(own, ids, with_ids))))

    schema = "did long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    texts = common.whole_texts(docs)
    out = texts.where(F.char_length("text") <= split_chars).mapInArrow(short, schema)
    longest = texts.agg(F.max(F.char_length("text"))).first()[0] or 0
    if longest > split_chars:
        parts = long_parts(texts, path, split_chars)
        count = -(-longest // split_chars)
        while count > 1:
            parts = join_round(parts, path)
            count = -(-count // 2)
        out = out.unionByName(parts.select("did", "ids").mapInArrow(finished, schema))
    return out.select(common.restore_id(), "ids", "n_tokens", "ids_sha256", "decoded_sha256")
