"""SentencePiece encoding that keeps, for every piece, the bytes of the source it stands for.

A text is normalised as the model's own specification says. At each place the
longest key of the compiled character map (a double-array trie over UTF-8
bytes) gives the replacement; where no key fits, the character stands for
itself. For every normalised byte the offset of the source character that it
comes from is kept, through the squeezing of blanks and the blank put before a
text. The normalised text is then split into pieces by the library, with a copy
of the model that does not normalise. Pieces tile the normalised text, so a
running sum of their lengths finds the two ends of each, and the kept offsets
take them back to the source.

Long normalised texts are encoded in blocks that end before a blank after
something else, if no piece of the vocabulary reaches across such a place; the
result is the same as without. Nothing is shuffled.

Spans follow the library: bytes that stand for a character outside the
vocabulary have empty spans at its start, but for the last, which has them all.

Defined results: null and empty texts have no pieces; a text of which
normalisation leaves nothing has none either; repeated rows and rows with a
null doc_id are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from vigil.llm import common

# The sign that stands for a blank, the replacement character, and codes of the model format.
BLANK = "▁"
BAD = "�"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)

# characters of a normalised text that are encoded in one go
BLOCK = 1 << 16
STRETCHES = re.compile(" *[^ ]+| +")
# replaced stretches kept per worker; a memory bound only
REMEMBERED = 300_000


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message, in order."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield number, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: 4 bytes of trie size, the trie's units, then strings ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def blank_inside(self) -> bool:
        """Whether a key may hold a blank behind its first byte."""
        if not self.units:
            return False
        at_root = self.child(self.below(0), 0x20) is not None
        return sum((u & 0x800000FF) == 0x20 for u in self.units) > at_root

    def below(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, key: bytes) -> tuple[bytes, int] | None:
        """Replacement and length in bytes of the longest key that ``key`` begins with."""
        found = None
        if not self.units:
            return None
        base = self.below(0)
        for i, byte in enumerate(key):
            node = self.child(base, byte)
            if node is None:
                break
            base = self.below(node)
            if self.units[node] & 0x100:
                start = self.units[base] & 0x7FFFFFFF
                found = self.strings[start : self.strings.index(0, start)], i + 1
        return found

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the bytes at a place, and how many they are: the longest key, else one character."""
        hit = self.longest(data[at : at + 256])
        if hit is None:
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            hit = data[at : at + size], size
        return hit

    def replace(self, data: bytes) -> tuple[bytes, list[int]]:
        """The replaced bytes, and for each the offset in ``data`` of what it comes from."""
        out: list[bytes] = []
        origin: list[int] = []
        at = 0
        while at < len(data):
            new, size = self.step(data, at)
            out.append(new)
            origin += [at] * len(new)
            at += size
        return b"".join(out), origin


def bytes_replaced_one_by_one(error: UnicodeError) -> tuple[str, int]:
    return BAD * (error.end - error.start), error.end


codecs.register_error("vigil-one-by-one", bytes_replaced_one_by_one)


def field(number: int, value: int | bytes) -> bytes:
    """One field of a protocol buffer message: a number below 128, or bytes."""
    if isinstance(value, int):
        return bytes([number * 8, value])
    size, rest = b"", len(value)
    while rest > 0x7F:
        size += bytes([rest & 0x7F | 0x80])
        rest >>= 7
    return bytes([number * 8 + 2]) + size + bytes([rest]) + value


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, data: bytes):
        norm: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        self.kinds: list[int] = []
        self.names: list[str] = []
        as_it_is = []
        for number, value in wire_fields(data):
            if number == 1:
                told = dict(wire_fields(value))
                self.names.append(told[1].decode())
                self.kinds.append(told.get(3, NORMAL))
            elif number == 2:
                trainer = dict(wire_fields(value))
            if number == 3:
                norm = dict(wire_fields(value))
                value = field(3, 0) + field(4, 0) + field(5, 0)
            as_it_is.append(field(number, value))
        self.map = CharacterMap(norm.get(2, b""))
        if trainer.get(24, 0) or USER_DEFINED in self.kinds or b"  " in self.map.strings:
            raise ValueError("blanks as endings, user-defined pieces and replacements by several blanks are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=b"".join(as_it_is))
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.blank = BLANK if norm.get(5, 1) else " "
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_shown = trainer.get(44, " \u2047 ".encode()).decode()
        # bytes that each id stands for, blanks being plain, and the normalised bytes that it covers
        self.bytes_of = [self.shown(i) for i in range(len(self.names))]
        self.sizes = np.array([1 if k == BYTE else len(n.encode()) for n, k in zip(self.names, self.kinds, strict=True)])
        self.digits = [str(i) for i in range(len(self.names))]
        self.in_blocks = not any(b == self.blank != a for n in self.names for a, b in zip(n, n[1:], strict=False))
        self.stretches = re.compile("(?s).+") if self.map.blank_inside() else STRETCHES
        self.replaced: dict[str, tuple[bytes, np.ndarray]] = {}

    def shown(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return self.unknown_shown.encode() if self.kinds[i] == UNKNOWN else self.names[i].replace(BLANK, " ").encode()

    def replace(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the text after the character map, and for each the offset of the source character."""
        if not self.map.units:
            data = np.frombuffer(text.encode(), np.uint8)
            starts = (data & 0xC0) != 0x80
            return data, np.maximum.accumulate(np.where(starts, np.arange(len(data)), 0))
        if len(self.replaced) > REMEMBERED:
            self.replaced.clear()
        parts, origins, at = [], [], 0
        for stretch in self.stretches.findall(text):
            raw = stretch.encode()
            if stretch not in self.replaced:
                new, origin = self.map.replace(raw)
                self.replaced[stretch] = new, np.array(origin, np.int64)
            new, origin = self.replaced[stretch]
            parts.append(new)
            origins.append(origin + at)
            at += len(raw)
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(origins) if origins else np.empty(0, np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes the offset of its source; one more offset gives the end."""
        if not text:
            return "", np.zeros(1, np.int64)
        data, origin = self.replace(text)
        source = text.encode()
        start, end = 0, len(source)
        if self.squeeze:
            while start < end and (step := self.map.step(source, start))[0] == b" ":
                start += step[1]
            blank = data == 0x20
            kept = ~(blank & np.concatenate(([True], blank[:-1])))
            data, origin = data[kept], origin[kept]
        if self.prefix and (len(data) or not self.squeeze):
            data, origin = np.concatenate(([np.uint8(0x20)], data)), np.concatenate(([start], origin))
        if self.blank != " ":
            origin = np.repeat(origin, np.where(data == 0x20, len(BLANK.encode()), 1))
        normal, origin = data.tobytes().decode("utf-8", "replace").replace(" ", self.blank), np.append(origin, end)
        if self.squeeze:  # signs for blanks that the text holds itself go as well at its end
            normal = normal.rstrip(self.blank)
            origin = origin[: len(normal.encode()) + 1]
        return normal, origin

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a normalised text of about ``BLOCK`` characters, each but the first beginning at a blank after something else."""
        start, wanted = 0, BLOCK
        while self.in_blocks and wanted < len(text):
            cut = text.find(self.blank, wanted)
            if cut < 0:
                break
            if text[cut - 1] == self.blank:
                wanted = cut + 1
                continue
            yield text[start:cut]
            start, wanted = cut, cut + BLOCK
        yield text[start:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text's pieces, and where the bytes each stands for begin and end in the text's UTF-8."""
        normal, origin = self.normalise(text)
        if not normal:
            return (np.empty(0, np.int32),) * 3
        if self.fallback:
            ids = np.concatenate([np.array(self.library.encode(b, num_threads=1), np.int32) for b in self.blocks(normal)])
            ends = np.cumsum(self.sizes[ids])
            begins = ends - self.sizes[ids]
        else:  # the length of an unknown piece is in no table
            pieces = self.library.encode(normal, return_type="proto", num_threads=1).pieces
            ids, begins, ends = (np.array([getattr(p, name) for p in pieces], np.int32) for name in ("id", "begin", "end"))
        return ids, origin[begins].astype(np.int32), origin[ends].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        shown = list(map(self.bytes_of.__getitem__, ids))
        if self.prefix or self.squeeze:
            # the blank before a text's first piece is left out, and if blanks are squeezed, before all until something shows
            for k, i in enumerate(ids):
                blank = shown[k][:1] == b" " and self.kinds[i] == NORMAL
                if blank:
                    shown[k] = shown[k][1:]
                if shown[k] or (blank and not self.squeeze):
                    break
        # bytes make a character only where no other piece stands between them
        runs = groupby(zip(ids, shown, strict=True), key=lambda piece: self.kinds[piece[0]] == BYTE)
        return "".join(b"".join(raw for _, raw in run).decode("utf-8", "vigil-one-by-one") for _, run in runs)

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """One model per file and Python worker."""
    with open(path, "rb") as file:
        return PieceModel(file.read())


SPANS = pa.schema([("did", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
DIGESTS = pa.schema(
    [
        ("did", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("spans_sha256", pa.string()),
    ]
)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends) of every document's whole text: piece ids and their byte spans in the text's UTF-8."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in common.batches_of(batches):
            columns = zip(*map(own.encode, batch.column(1).to_pylist()), strict=True)
            yield common.pack(SPANS, batch.column(0), *map(list, columns))

    out = common.whole_texts(docs).mapInArrow(rows, "did long, ids array<int>, begins array<int>, ends array<int>")
    return out.select(common.restore_id(), "ids", "begins", "ends")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of every document's whole text.

    ``spans_sha256`` is taken over the begins, then the ends, as 4-byte little-endian integers.
    """

    def row(own: PieceModel, text: str) -> tuple[int, str, str, str]:
        ids, begins, ends = own.encode(text)
        spans = hashlib.sha256(begins.astype("<i4").tobytes() + ends.astype("<i4").tobytes())
        listed = ids.tolist()
        return (
            len(listed),
            hashlib.sha256(own.listed(listed).encode()).hexdigest(),
            hashlib.sha256(own.decode(listed).encode()).hexdigest(),
            spans.hexdigest(),
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in common.batches_of(batches):
            columns = zip(*(row(own, t) for t in batch.column(1).to_pylist()), strict=True)
            yield common.pack(DIGESTS, batch.column(0), *map(list, columns))

    schema = "did long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    out = common.whole_texts(docs).mapInArrow(rows, schema)
    return out.select(common.restore_id(), "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
