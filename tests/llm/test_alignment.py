"""Alignment of two tokenizers: against plain loops, fragments in any grouping, awkward texts, long documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugewatch.llm import alignment as al

SCHEMA = "doc_id long, text string, block long, row string, pos int"
FILES = al.default_files()
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


def tokens(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    raw_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, B.id_to_piece(i)) for i in b)]
    return a, raw_a, b, raw_b


def groups(text):
    if not text:
        return []
    a, raw_a, b, raw_b = tokens(text)
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        own_a, own_b, end_a, end_b = [a[i]], [b[j]], len(raw_a[i]), len(raw_b[j])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                own_a.append(a[i])
                end_a += len(raw_a[i])
                i += 1
            else:
                own_b.append(b[j])
                end_b += len(raw_b[j])
                j += 1
        out.append((own_a, own_b))
    return out


def brute(rows):
    found = [(doc_id, groups(text)) for doc_id, text in rows]
    docs = Counter()
    links = []
    for _, own in found:
        own_links = [(x, y) for a, b in own for x in a for y in b]
        docs.update(set(own_links))
        links.append(own_links)
    highest = defaultdict(int)
    for (x, _), n in docs.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, own), own_links in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((
            doc_id, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(own_links),
            sum(docs[p] == highest[p[0]] for p in own_links), sum(docs[p] for p in own_links),
            hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "Hello world, it's 12 o'clock.\n\n  Next  line\t\t"), (5, "naïve Ünï 漢字 🙂 x　y"),
    (6, "x<|endoftext|>y <s> </s> <unk> <0x41>"), (7, "same"), (7, "same"), (7, "other words"), (None, "no id"), (None, "no id"),
    (8, "a▁b"), (9, "\x00\x01"), (10, "ﬁ ① é 한글"), (11, "=" * 700 + "é" * 300), (12, " lead and trail "),
]


def long_text(seed, words):
    rng = random.Random(seed)
    pool = ["word", "naïve", "漢字漢字", "internationalisation", "x" * 50, "  ", "\n", "2024-01-01", "a.b.c", "🙂🙂", "привет", "'s"]
    return " ".join(rng.choice(pool) for _ in range(words))


@pytest.mark.parametrize("sizes", [{}, {"long": 200, "piece": 150, "width": 16, "fan": 2, "block": 300}, {"long": 0, "piece": 40, "width": 64, "fan": 3}])
def test_brute_force(spark, sizes):
    rows = [*AWKWARD, (20, long_text(1, 700)), (21, long_text(2, 300)), (22, long_text(2, 300)), (23, "漢字" * 400 + "▁" + "x" * 90), (24, "字" * 900)]
    got = al.align(frame(spark, rows).repartition(3), **sizes)
    assert sorted(key(r) for r in got.documents.collect()) == sorted(key(r) for r in brute(rows))


def test_pairs_of_the_corpus(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a c", "a a a", None, "strange wordings"])]
    docs = Counter()
    for _, text in rows:
        docs.update({(x, y) for a, b in groups(text) for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in docs.items():
        highest[x] = max(highest[x], n)
    got = {(r.a_id, r.b_id): (r.docs, r.best) for r in al.align(frame(spark, rows)).pairs.collect()}
    assert got == {p: (n, n == highest[p[0]]) for p, n in docs.items()}


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, al.digest(df).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert al.digest(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_pieces_have_the_tokens_of_the_whole():
    both = al.tokenizers(*FILES)
    for seed in range(5):
        text = long_text(seed, 400)
        a, b, size = both.encode(text)
        parts = [both.encode(p) for _, p in al.pieces_of(text, 64)]
        assert len(parts) > 10
        assert np.concatenate([p[0] for p in parts]).tolist() == a.tolist() and np.concatenate([p[1] for p in parts]).tolist() == b.tolist()
        starts = [at for at, _ in al.pieces_of(text, 64)]
        assert np.cumsum([0, *(p[2] for p in parts)]).tolist() == [*starts, size]


@pytest.mark.parametrize("seed", range(4))
def test_monoid(seed):
    """Any grouping of neighbours gives the groups of the whole, each one once."""
    both = al.tokenizers(*FILES)
    rng = random.Random(seed)
    text = long_text(seed, 60)
    a, b, size = both.encode(text)
    end_a, end_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
    parts = []
    for low in range(0, size, 8):
        (p, q), (r, s) = (np.searchsorted(e, [low, low + 8], "right") for e in (end_a, end_b))
        edge, inner_a, inner_b = al.fragment(a[p:q], end_a[p:q], b[r:s], end_b[r:s])
        parts.append((edge, {low: (inner_a.tolist(), inner_b.tolist())} if len(inner_a) else {}))
    opened = sum(len(e.pre_a) + len(e.pre_b) > 0 for e, _ in parts)
    total = sum(len(inner) for _, inner in parts)
    assert opened > 10 and total
    joints = 0
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        edge, group = al.compose(parts[k][0], parts[k + 1][0])
        joints += group is not None
        parts[k : k + 2] = [(edge, {})]
    root = parts[0][0]
    assert root.closed and not len(root.suf_a) and not len(root.suf_b)
    assert joints + 1 == sum(1 for _ in range(0, size, 8) if np.intersect1d(end_a[(end_a > _) & (end_a <= _ + 8)], end_b).size)


def test_large_groups_are_counted_by_ids():
    both = al.tokenizers(*FILES)
    a, b = np.array([5, 6] * 100), np.array([7] * 80)
    codes, weights, group = al._links(a, b, np.zeros(200, np.int64), np.zeros(80, np.int64), 1, both)
    assert dict(zip(codes.tolist(), weights.tolist(), strict=True)) == {5 * both.n_b + 7: 8000, 6 * both.n_b + 7: 8000}
    assert set(group.tolist()) == {0}


def test_stretches_together_are_as_each_alone():
    both = al.tokenizers(*FILES)
    docs = [both.encode(t)[:2] for t in ("Hello world", "x", long_text(3, 50), "x", "漢字")]
    for one, own in zip(al.groups_of(docs, both), docs, strict=True):
        alone = al.whole(*own, both)
        assert one[:3] == alone[:3] and one.codes.tolist() == alone.codes.tolist() and one.weights.tolist() == alone.weights.tolist()


def test_groups_with_spans(spark):
    rows = {(r.start, r.end): (r.a_ids, r.b_ids) for r in al.groups(frame(spark, [(1, "Hello wörld"), (2, None)])).collect()}
    own = groups("Hello wörld")
    assert [rows[k] for k in sorted(rows)] == own and max(rows)[1] == len("Hello wörld".encode())
