"""Dedup, language model, BPE, toxicity and decontamination against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from plain_texts import awkward, classes, distance_within, kept_bytes, lower, nothing, removed_words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import bpe, common, decontaminate, lm_scoring, minhash_dedup, spans, substring_dedup, suffix_dedup, toxicity

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark):
    docs = common.read_table(spark, FOLDER, "documents")
    return docs, [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def pieces(seed, alphabet, length, most):
    draw = random.Random(seed)
    base = [[draw.choice(alphabet[: draw.randint(1, len(alphabet))]) for _ in range(length)] for _ in range(4)]
    rows = []
    for i in range(25):
        text = []
        for _ in range(draw.randint(0, 5)):
            at = draw.randrange(length)
            text += draw.choice(base)[at : at + draw.randint(0, most)]
        rows.append((i, text))
    return rows


def as_dict(result):
    return {r[0]: tuple(r[1:]) for r in result.collect()}


def test_equal_windows_pick_equal_anchors():
    draw = np.random.default_rng(1)
    text = bytes(draw.integers(97, 100, 600).astype(np.uint8))
    data, bounds = spans.join_texts([text, text[100:400], b"short", text[37:]])
    runs, rolling = spans.winnow(spans.BYTE_CODES[data], bounds, 50, 8)
    picked = {}
    for gram, first, count in zip(runs.grams, runs.first, runs.count, strict=True):
        for start in range(first, first + count):
            window = data[start : start + 50].tobytes()
            assert picked.setdefault(window, gram) == gram
    assert runs.count.sum() == sum(max(0, n - 49) for n in (600, 300, 5, 563))


def test_substrings(spark):
    docs, rows = documents(spark)
    assert as_dict(substring_dedup.deduplicate(docs)) == removed_words(rows, 20)
    for seed in range(2):
        rows = [(i, " ".join(t)) for i, t in pieces(seed, ["x", "y", "zz", "é"], 120, 60)]
        made = spark.createDataFrame(rows, "doc_id long, text string")
        assert as_dict(substring_dedup.deduplicate(made)) == removed_words(rows, 20)


def test_suffixes(spark):
    docs, rows = documents(spark)
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.deduplicate(docs).collect()}
    assert found == {k: v[1:] for k, v in kept_bytes(rows, 100).items()}
    for seed in range(2):
        rows = [(i, "".join(t)) for i, t in pieces(seed, ["a", "b", "é", "c "], 400, 200)]
        made = spark.createDataFrame(rows, "doc_id long, text string")
        kept = {r.uid: r.kept for r in suffix_dedup.kept_texts(made).collect()}
        assert kept == {k: v[0].decode("utf-8", "ignore") for k, v in kept_bytes(rows, 100).items()}


def test_repeat_groups_list_every_occurrence(spark):
    shared = "".join(random.Random(2).choices("abcdefgh ", k=130))
    rows = [(1, "x1" + shared + "1y"), (2, "x2" + shared + "2y"), (3, shared), (4, "nothing of it")]
    found = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        text = dict(rows)[r.doc_id].encode()[r.start : r.start + r.bytes]
        groups.setdefault(r.group, set()).add((r.doc_id, text))
    assert groups and all(len({t for _, t in g}) == 1 and {d for d, _ in g} == {1, 2, 3} for g in groups.values())


def test_intervals_of_a_known_array():
    # suffixes of banana from the third common byte on would be none; depth 1 and more: a (3), ana (2), na (2), n..
    text = b"banana"
    order = sorted(range(6), key=lambda i: text[i:])
    lcp = [0] + [len(common_prefix(text[a:], text[b:])) for a, b in zip(order, order[1:], strict=False)]
    left = [text[i - 1] if i else -1 for i in order]
    assert sorted(suffix_dedup.intervals(lcp, left, 1)) == [(1, 0, 2), (3, 1, 2)]


def common_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def test_near_duplicates(spark):
    docs, rows = documents(spark)
    want = classes(rows, 3, 85)
    found = as_dict(minhash_dedup.near_duplicates(docs))
    assert found == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_duplicates_of_a_hot_group(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(120)] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    want = classes(rows, 3, 85)
    found = as_dict(minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert found == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_least_matches():
    m = minhash_dedup.least_matches(24, 0.85, 1e-6)
    tail = [sum(math.comb(24, k) * 0.85**k * 0.15 ** (24 - k) for k in range(n)) for n in (m, m + 1)]
    assert tail[0] <= 1e-6 < tail[1]


def test_language_model(spark):
    docs, rows = documents(spark)
    tokens = {d: [*lower(t).split(), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    for d, own in tokens.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own), rel=1e-9)
    unseen = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_class_scores_are_probabilities():
    draw = np.random.default_rng(4)
    seen, deleted = draw.poisson(0.6, (2, 6, 6, 6))
    seen[:, :, 5] = deleted[:, :, 5] = 0
    seen[3, 2] = 0
    scores = lm_scoring.class_scores(seen, deleted, 30).reshape(6, 6, 6)
    assert np.allclose((10**scores).sum(axis=2), 1)
    early, late = (lm_scoring.learn_weights(seen, deleted, n) for n in (1, 30))

    def fit(weights):
        orders, buckets = lm_scoring.estimates(seen)
        mixed = sum(weights[buckets][:, :, None, k] * orders[k] for k in range(4))
        return (deleted[deleted > 0] * np.log(mixed[deleted > 0])).sum()

    assert fit(late) > fit(early)


def test_language_model_tells_all_words_apart(spark):
    draw = random.Random(5)
    follows = {k: [draw.randrange(150) for _ in range(3)] for k in range(150)}
    rows = []
    for i in range(160):
        words = [draw.randrange(150)]
        while len(words) < 40:
            words.append(draw.choice(follows[words[-1]]))
        rows.append((i, " ".join(f"w{w}" for w in words)))
    usual = next(t for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2)
    spare = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows += [(spare[0], usual), (spare[1], " ".join(reversed(usual.split()))), (spare[2], "new w1 w2 words"), (spare[3], "")]
    found = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found[spare[0]].score > found[spare[1]].score + 10
    # the counts of the whole vocabulary in one array: 0 is for unseen words, the last class for the start
    folds = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in rows}
    seen = sorted({w for i, t in rows if folds[i] != 2 for w in t.split()}) + [None]
    width = len(seen) + 2
    assert width > 127
    place = {w: k for k, w in enumerate(seen, 1)}
    counts, trigrams = np.zeros((2, width, width, width), dtype=np.int64), {}
    for i, text in rows:
        own = [width - 1, width - 1, *(place.get(w, 0) for w in [*text.split(), None])]
        trigrams[i] = list(zip(own, own[1:], own[2:], strict=False))
        for gram in trigrams[i] if folds[i] != 2 else ():
            counts[int(folds[i] == 3)][gram] += 1
    scores = lm_scoring.class_scores(*counts, 20).reshape(width, width, width)
    for i, own in trigrams.items():
        assert found[i].score == pytest.approx(sum(scores[g] for g in own), rel=1e-9)


def test_bpe_equals_the_library(monkeypatch):
    own, library = bpe.Codec(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    draw = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "'ll", "12", "!", "é", "漢字", "😀", "<|endoftext|>", "A" * 50, "ab" * 30, "\x1c", " \n"]
    for _ in range(600):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        monkeypatch.setattr(bpe, "WHOLE", draw.choice([5, 16, 50, 4096]))
        own.first.clear()
        own.after.clear()
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.text_of(want) == library.decode(want, skip_special_tokens=False)
        ids = [own.encode(p) for p in bpe.cut_parts(text, draw.choice([7, 20, 100]), list(own.special))]
        while len(ids) > 1:
            ids = [bpe.join_ids(own, *ids[i : i + 2]) if i + 1 < len(ids) else ids[i] for i in range(0, len(ids), 2)]
        assert (ids[0] if ids else []) == want, text


def test_bpe_of_documents(spark):
    docs, rows = documents(spark)
    library = Tokenizer.from_file(VOCABULARY)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    for split in (1 << 16, 500):
        found = {r.doc_id: r.ids for r in bpe.encode(docs, VOCABULARY, split_chars=split).collect()}
        assert found == want


def test_toxicity_on_held_out_labels(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = common.read_table(spark, "/root/testdata/sf0.1", "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where(common.fold(5) == 0).join(labels, "doc_id").collect()
    found = {k: [r.tox_score >= 0.5 for r in scored if r.toxic == k] for k in (0, 1)}
    assert sum(found[0]) / len(found[0]) < 0.02
    assert sum(found[1]) / len(found[1]) > 0.7


def plain_score(model, text):
    """The score from its definition: grams one by one, each distinct one counted once."""
    data = b" " + text.encode()
    data = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in data)
    found = set()
    for i in range(len(data) - toxicity.GRAM + 1):
        gram = data[i : i + toxicity.GRAM]
        if b" " not in gram[1:-1]:
            found.add((int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 % 2**64) >> 44)
    found.discard(0)
    known = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    factor, tilt, constant = model.calibration
    odds = factor * (model.bias + math.fsum(known.get(b, 0.0) for b in found))
    odds += tilt * max(0.0, math.log(1 + len(found)) - model.mean_length) + constant
    return 1 / (1 + math.exp(-min(50, max(-50, odds))))


def test_toxicity_scores_equal_plain_ones(spark):
    docs = common.read_table(spark, FOLDER, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Straße STRASSE ßß a b c"), (-4, "idiot " * 9000)], docs.schema)
    model = toxicity.train(docs, common.read_table(spark, FOLDER, "labels"))
    rows = toxicity.score(docs.unionByName(more), model).collect()
    assert len(rows) == docs.count() + 4
    for r in rows:
        assert abs(r.tox_score - plain_score(model, r.text or "")) < 1e-9


def test_calibration_maximises_its_likelihood():
    draw = np.random.default_rng(3)
    raw, beyond = draw.normal(size=500) * 3, np.maximum(0, draw.normal(size=500))
    toxic = (draw.random(500) < toxicity.sigmoid(0.5 * raw - beyond - 1)).astype(float)

    def loss(at, prior):
        z = at[0] * raw + at[1] * beyond + at[2]
        off = (at[0] - 1) ** 2 + at[1] ** 2 + at[2] ** 2
        return np.sum(np.logaddexp(0, z) - toxic * z) + prior * off / 2

    for prior in (1.0, 10.0):
        at = np.array(toxicity.calibrated(raw, beyond, toxic, prior))
        least = loss(at, prior)
        assert all(loss(at + step, prior) >= least for step in draw.normal(size=(200, 3)) * 0.01)
    assert np.allclose(toxicity.calibrated(raw, beyond, toxic, 1e9), (1, 0, 0), atol=1e-4)


def test_long_clean_texts_are_left_alone(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = common.read_table(spark, "/root/testdata/sf0.1", "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    clean = scored.where((common.fold(5) == 0) & (F.col("toxic") == 0))
    share = F.avg((F.col("tox_score") >= 0.5).cast("int"))
    long, rest = (clean.where(kept).agg(share).first()[0] for kept in ("length(text) > 5000", "length(text) <= 5000"))
    assert long < 0.03 and rest < 0.02


def test_swaps_lower_the_weight_of_groups(spark):
    draw = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = [draw.choice(["plain", "river", "stone", "letter", "window"]) for _ in range(12)]
        # one group is named far more often in toxic texts
        group = "muslims" if draw.random() < (0.9 if toxic else 0.2) else "christians"
        if toxic and draw.random() < 0.7:
            words.append("vermin")
        rows.append((i, " ".join([*words, group])))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")

    def gap(pull):
        model = toxicity.train(docs, told, pull=pull)
        a, b = model.log_odds([b"plain river muslims", b"plain river christians"])
        return abs(a - b), model.log_odds([b"plain vermin"])[0] - model.log_odds([b"plain river"])[0]

    free, held = gap(0.0), gap(20.0)
    assert held[0] < 0.3 * free[0]
    assert held[1] > 0


def test_swapper():
    swap = toxicity.swapper({"g": ["men", "women"], "f": ["a b", "c"]})
    assert swap("Women and men, a b!") == "men and women, c!"
    assert swap("mental") is None


def test_decontamination_finds_edited_items(spark):
    docs, rows = documents(spark)
    benchmark = common.read_table(spark, FOLDER, "benchmark")
    items = [(r.item_id, decontaminate.plain(r.text.encode())) for r in benchmark.collect()]
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find(docs, benchmark).collect()}
    verbatim = {(d, i) for d, t in rows for i, item in items if item in decontaminate.plain(t.encode())}
    assert verbatim and verbatim <= set(found) and all(found[k] == 0 for k in verbatim)
    index = decontaminate.Index(items, 10)
    draw = random.Random(8)
    for _ in range(60):
        k = draw.randrange(len(items))
        edited = bytearray(items[k][1])
        for _ in range(draw.randint(0, int(index.budget[k]))):
            at = draw.randrange(len(edited))
            edited[at : at + draw.randint(0, 1)] = bytes([draw.randrange(97, 123)]) * draw.randint(0, 1)
        text = rows[draw.randrange(len(rows))][1].encode()[:300] + b" " + bytes(edited) + b" end"
        own = [r for r in decontaminate.regions(index, [text]) if r[1] == items[k][0]]
        assert own and min(r[2] for r in own) == distance_within(items[k][1], decontaminate.plain(text))


def test_short_items_are_found_verbatim(spark):
    """Items without room for edits stand between word bounds; repeated items and null ids have rows of their own."""
    texts = ["Well: what is  17\ntimes 23? No.", "what is 17 times 23", "somewhat is 17 times 23?", "Ja, ja ja", "", None, "caf\u00e9 ja\u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(1, "What is 17 times 23?"), (2, "ja"), (None, "ja"), (3, " "), (4, None), (5, "ja ja")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect())
    assert found == {(0, 1): 1, (3, 2): 3, (3, None): 3, (3, 5): 1}
    first = decontaminate.find(docs, items.where("item_id = 1")).first()
    assert (first.edits, first.similarity, first.start, first.end) == (0, 1.0, 6, 26)
    # a word or two are in clean documents too
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.doc_id for r in decontaminate.clean(docs, items, least_words=1).collect()} == {1, 2, 4, 5, 6}


def test_clean_documents_stay(spark):
    docs, _ = documents(spark)
    benchmark = common.read_table(spark, FOLDER, "benchmark")
    hit = {r.doc_id for r in decontaminate.find(docs, benchmark).collect()}
    left = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.collect()} - hit
    # more blocks than one give the same
    small = {r.doc_id for r in decontaminate.clean(docs, benchmark, block_bytes=2000).collect()}
    assert small == left


OPERATORS = {
    "near": lambda d: minhash_dedup.near_duplicates(d),
    "words": lambda d: substring_dedup.deduplicate(d),
    "bytes": lambda d: suffix_dedup.deduplicate(d),
    "lm": lambda d: lm_scoring.score(d),
    "bpe": lambda d: bpe.encode(d, VOCABULARY, split_chars=2000),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    found = OPERATORS[name](docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())
    # rows equal in doc_id and text have equal results
    assert len({tuple(map(str, r)) for r in found if r.doc_id == 4}) <= 2
    assert OPERATORS[name](nothing(spark)).count() == 0


def test_awkward_near_duplicates(spark):
    found = minhash_dedup.near_duplicates(awkward(spark)).collect()
    told = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in found}
    assert told[1, 0] == (1, True) and told[3, 0] == (3, True)
    assert told[9, 1] == (8, False)
    # the null doc_id is the smallest: its copies belong to it
    assert [r.kept for r in found if r.doc_id == 5] == [False]


def test_awkward_toxicity_and_decontamination(spark):
    docs, empty = awkward(spark), nothing(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (7, 5), (2, 0)], "doc_id long, toxic int")
    none = labels.limit(0)
    for told in (labels, none):
        model = toxicity.train(docs, told)
        assert toxicity.score(docs, model).count() == 13 and toxicity.score(empty, model).count() == 0
    items = spark.createDataFrame([(1, None), (2, "short"), (3, "quick brown fox jumps over a lazy dog near the old mill"), (None, "")], "item_id long, text string")
    found = decontaminate.find(docs, items).collect()
    assert {r.item_id for r in found} == {3} and {r.doc_id for r in found} == {4, 5, None}
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.find(empty, items).count() == 0
