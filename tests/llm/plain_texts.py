"""Plain-Python statements of the operators' results, and awkward inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

SPACES = b" \t\n\x0b\x0c\r"


def lower(text: str) -> bytes:
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def awkward(spark):
    """Nulls, empties, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 97}" for i in range(3000))
    base = "the quick brown fox jumps over a lazy dog near the old mill " * 4
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, base), (4, base), (4, base + "tail"), (5, base), (6, long), (7, long[:9000]),
        (None, base), (None, "é漢字😀 <|endoftext|> x"), (8, "one two"), (9, "one two"),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long, did long, uid string, score int, label string, open int, segment int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "u", 2, "l", 3, 4) for i, t in rows], columns)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def removed_words(rows, window):
    seen, out = set(), {}
    for did, text in sorted(rows):
        words = text.encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                covered[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[did] = (len(words), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def kept_bytes(rows, window):
    seen, out = set(), {}
    for did, text in sorted(rows):
        data = text.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - window + 1):
            key = data[i : i + window]
            if key in seen:
                covered[i : i + window] = b"\x01" * window
            seen.add(key)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out[did] = (bytes(b for b, c in zip(data, covered, strict=True) if not c), sum(covered), spans)
    return out


def classes(rows, width, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {}
    for did, text in rows:
        words = lower(text).split()
        many = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets[did] = frozenset(many)
    holders = defaultdict(list)
    for did, own in sets.items():
        for shingle in own:
            holders[shingle].append(did)
    parent = {did: did for did in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for did, own in sets.items():
        shared = Counter(other for shingle in own for other in holders[shingle] if other < did)
        for other, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = top(did), top(other)
                parent[max(a, b)] = min(a, b)
    return {did: (len(own), top(did)) for did, own in sets.items()}


def distance_within(goal: bytes, text: bytes) -> int:
    """Least edits between goal and any part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(goal, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)
