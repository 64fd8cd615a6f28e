"""Pieces with spans, tokenizer alignment and hard negatives against the libraries and plain Python."""

import hashlib
import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from plain_texts import awkward, nothing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import common, hard_negatives, piece_spans, queries, token_alignment
from vigil.llm.bpe import byte_letters

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SIGNS = ["a", " ", "  ", "▁", "　", "é", "😀", "\n", "\t", "the", "ing", " the", "<s>", "<unk>", "<0x0A>", "\x00", "中文", "ก", " ", "ﬁ", "㍿", "Å", "å", "​", "0"]


def drawn(seed, count, most=40):
    draw = random.Random(seed)
    return ["".join(draw.choices(draw.sample(SIGNS, draw.randint(1, len(SIGNS))), k=draw.randint(0, most))) for _ in range(count)]


def library_spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def own_spans(model, text):
    return list(zip(*(x.tolist() for x in model.encode(text)), strict=True))


def with_normaliser(rule, prefix, squeeze):
    """The model file with another character map and other rules for blanks."""
    spec = bytes(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    blob = dict(piece_spans.wire_fields(spec)).get(2, b"")
    norm = b"".join([piece_spans.field(2, blob) if blob else b"", *(piece_spans.field(n, v) for n, v in ((3, prefix), (4, squeeze), (5, 1)))])
    data = open(PIECES, "rb").read()
    return b"".join(piece_spans.field(n, norm if n == 3 else v) for n, v in piece_spans.wire_fields(data))


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_spans_and_texts_under_other_normalisers(rule, prefix, squeeze):
    data = with_normaliser(rule, prefix, squeeze)
    own, library = piece_spans.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in [*drawn(5, 250), " ", "▁▁ a", "​ ​", " 　 x  "]:
        found = own_spans(own, text)
        assert found == library_spans(library, text)
        ids = [i for i, _, _ in found]
        assert own.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids():
    own, library = piece_spans.model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(7)
    for _ in range(300):
        ids = [draw.choice([0, 1, 2, draw.randrange(3, 259), draw.randrange(32000), 28705, 259]) for _ in range(draw.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_blocks_do_not_show(monkeypatch):
    text = "  ".join(drawn(9, 60)) + "x" * 300
    own = piece_spans.model(PIECES)
    whole = own_spans(own, text)
    monkeypatch.setattr(piece_spans, "BLOCK", 7)
    assert own_spans(own, text) == whole


def test_spans_cover_their_pieces(spark):
    docs = common.read_table(spark, FOLDER, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    own = piece_spans.model(PIECES)
    for r in piece_spans.encode(docs, PIECES).collect():
        for i, a, b in list(zip(r.ids, r.begins, r.ends, strict=True))[1:]:
            assert own.kinds[i] == piece_spans.BYTE or texts[r.doc_id][a:b] == own.bytes_of[i]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in common.read_table(spark, FOLDER, "documents").collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_pieces"](spark, FOLDER).collect()}
    ids = {d: library.encode(t) for d, t in texts.items()}
    assert found == {d: (len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for d, i in ids.items()}


def test_pieces_of_awkward_rows(spark):
    docs = awkward(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r.doc_id, len(library.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens) for r in piece_spans.digests(docs, PIECES).collect()) == want
    assert piece_spans.encode(nothing(spark), PIECES).count() == 0


def ends(tokens):
    at = 0
    for i, raw in tokens:
        at += len(raw)
        yield i, at


def plain_alignment(rows):
    """Summaries by a plain pass over all links of all texts, with the libraries' own tokens."""
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    pieces, letters = sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_letters()
    told, linked = [], []
    for doc, text in rows:
        text = text or ""
        wanted = b" " + text.encode()
        one = tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
        names = [(i, pieces.id_to_piece(i)) for i in pieces.encode(text)]
        b = [(i, bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode()) for i, n in names]
        if not text or not b"".join(x for _, x in a) == wanted == b"".join(x for _, x in b):
            told.append((doc, 0, 0, 0, 0, ""))
            linked.append([])
            continue
        cuts = sorted({e for _, e in ends(a)} & {e for _, e in ends(b)})
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for i, e in ends(tokens):
                groups[bisect_left(cuts, e)][side].append(i)
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        linked.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        told.append((doc, len(a), len(b), len(cuts), len(linked[-1]), sha(written)))
    counts = Counter(pair for own in linked for pair in set(own))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return Counter(
        (*t, sum(counts[p] == highest[p[0]] for p in own), sum(counts[p] for p in own)) for t, own in zip(told, linked, strict=True)
    )


def alignment_rows(result):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in result.collect())


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in common.read_table(spark, FOLDER, "documents").collect()]
    assert alignment_rows(queries.QUERIES["op13_alignment"](spark, FOLDER)) == plain_alignment(rows)


def test_alignment_of_drawn_and_awkward_rows(spark):
    rows = list(enumerate([*drawn(3, 200), "😀" * 300 + "aกข" * 200, "a b"]))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert alignment_rows(token_alignment.summaries(made, BPE, PIECES)) == plain_alignment(rows)
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert alignment_rows(token_alignment.summaries(docs, BPE, PIECES)) == plain_alignment(rows)
    assert token_alignment.summaries(nothing(spark), BPE, PIECES).count() == 0
    without = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert alignment_rows(token_alignment.summaries(without, BPE, PIECES)) == plain_alignment([(1, None), (2, "")])


def test_links_in_pieces(monkeypatch):
    pair = token_alignment.tokenizers(BPE, PIECES)
    found = token_alignment.align(pair, [*drawn(4, 20), "ก" * 50])
    whole = token_alignment.links(pair, found)
    monkeypatch.setattr(token_alignment, "PAIRS", 3)
    cut = token_alignment.links(pair, found)
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))


def test_groups_give_ranges_and_ids(spark):
    docs = spark.createDataFrame([(1, "hello wörld"), (2, None)], "doc_id long, text string")
    rows = sorted(token_alignment.groups(docs, BPE, PIECES).collect(), key=lambda r: r.begin)
    pair = token_alignment.tokenizers(BPE, PIECES)
    data = " hello wörld".encode()
    assert [r.doc_id for r in rows] == [1] * len(rows) and rows[0].begin == 0 and rows[-1].end == len(data)
    for r, following in zip(rows, [*rows[1:], None], strict=True):
        assert following is None or following.begin == r.end
        assert pair.a.raw(r.a_ids) == data[r.begin : r.end] == b"".join(pair.b.bytes_of[i] for i in r.b_ids)


def plain_negatives(rows, is_anchor, scale=256):
    """Every anchor against every row."""
    used = []
    for row, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((row, i, label, [math.floor(scale * x) for x in v]))
    out = []
    for row, i, label, v in used:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, other, k) for other, j, k, w in used if other != row)
        for s, j, _, k in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _, _) in enumerate(fits, 1)]
    return Counter(out)


def vectors_of(spark, rows):
    made = spark.createDataFrame(rows, "id long, label int, e array<double>").repartition(3)
    return made.select("id", "label", hard_negatives.integers(F.col("e"), 256).alias("v"), F.lit(1).alias("row"), F.lit("x").alias("ranges"))


@pytest.mark.parametrize("kind", ["spread", "bunched", "short", "equal"])
def test_negatives(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "MEMBERS", 3)
    draw = random.Random(kind)
    rows = []
    for i in range(400):
        v = [draw.gauss(0, 0.3) for _ in range(6)]
        if kind == "bunched":
            v = [x + 3 * (d == i % 2) for d, x in enumerate(v)]
        elif kind == "short":
            v = v[: draw.randint(0, 6)]
        elif kind == "equal":
            v = [float(i % 4), 1.0, 0.0, 0.5, 0.0, 0.0]
        rows.append((i % 350, draw.randrange(3), v))
    rows += [(700, None, [1.0] * 6), (701, 1, None), (702, 1, [1.0, None]), (703, 1, [math.nan] * 6), (704, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (705, 99, [1.0] * 6), (7000, 2, [])]
    found = hard_negatives.mine(vectors_of(spark, rows), F.col("id") % 10 == 0, least_blocks=3)
    columns = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_walks_end_early():
    """Bunched rows: once the lists are full, most of a batch is left unread."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(1)
    rows = np.floor(draw.normal(0, 20, (4000, 8)) + 256 * np.eye(8)[np.arange(4000) % 8]).astype(np.int64)
    no_limits = [[{"low": hard_negatives.LOWEST, "high": hard_negatives.HIGHEST}]] * 8
    asking = pa.table({"v": pa.chunked_array([pa.array(rows[:8].tolist())]), "row": np.arange(8), "label": np.zeros(8, np.int64), "ranges": no_limits})
    search = hard_negatives.Search(asking, 10, True)
    read = []
    inner = search.enter
    search.enter = lambda members, score, *rest: (read.append(score.size), inner(members, score, *rest))
    order = np.arange(4000)
    monkey = hard_negatives.STEP
    hard_negatives.STEP = 64
    try:
        search.walk(order, order, np.zeros(4000, np.int64), rows)
    finally:
        hard_negatives.STEP = monkey
    assert sum(read) < 0.5 * 8 * 4000
    for i in range(8):
        score = rows @ rows[i]
        score[i] = -(1 << 60)
        assert sorted(search.lists[i, 0][:, 0]) == sorted(score)[-10:]


def test_no_vectors(spark):
    empty = vectors_of(spark, [(1, 1, [1.0])]).where("id > 1")
    assert hard_negatives.mine(empty, F.col("id") % 10 == 0).count() == 0
