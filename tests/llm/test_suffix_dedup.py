"""Suffix sorting and repeated bytes against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gaugewatch.llm import suffix_array, suffix_dedup
from gaugewatch.llm.suffix_array import DEPTH, common_prefixes, suffix_order, words


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
@pytest.mark.parametrize("size", [1, 2, 17, 700])
def test_suffix_order(alphabet, size):
    rng = random.Random(size)
    text = "".join(rng.choice(alphabet) for _ in range(size)).encode()
    text = np.frombuffer(text, np.uint8)
    order = suffix_order(text)
    raw = text.tobytes() + bytes(DEPTH)
    assert sorted(order.tolist()) == list(range(size))
    keys = [raw[i : i + 50] for i in order]
    assert keys == sorted(keys)
    want = [0]
    for a, b in zip(keys, keys[1:]):
        n = 0
        while n < 50 and a[n] == b[n]:
            n += 1
        want.append(n)
    assert [min(50, n) for n in common_prefixes(order, words(text)).tolist()] == want


def brute(rows, length=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    for doc_id, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, key(doc_id)), key(doc_id))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < key(doc_id):
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), "the very common line that is in many of the documents here."
    base = prose(200)
    rows = [(i, prose(rng.randint(1, 150))) for i in range(60)]
    rows += [(100 + i, prose(30) + passage + prose(30) + passage) for i in range(6)]
    rows += [(200 + i, line + prose(20) + line + prose(5)) for i in range(12)]
    rows += [(300 + i, base) for i in range(8)]
    for i in range(12):
        words_ = base.split()
        for _ in range(3):
            words_[rng.randrange(len(words_))] = word()
        rows.append((400 + i, " ".join(words_)))
    rows += [(500, "x" * 5000), (501, "x" * 300), (502, "y" + "x" * 49), (503, "x" * 49), (504, None), (505, ""), (506, base[:50])]
    rows += [(None, base), (None, base), (300, base), (7, passage), (0, prose(40)), (600, passage[1:51] + "~" + passage[1:50])]
    rows += [(601, "漢字" * 60), (602, "漢字" * 20), (603, "字漢" * 20)]
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block_ int, row_ string")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.remove_repeats(docs.repartition(5), ["doc_id"], names, hot).select("row_.doc_id", *names).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_cleaned_keeps_rows_and_columns(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    out = suffix_dedup.cleaned(docs)
    assert out.schema == docs.schema or out.dtypes == docs.dtypes
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    want = {h for *_, h in brute(rows)}
    assert {hashlib.sha256(r.text.encode()).hexdigest() for r in got} <= want | {
        hashlib.sha256(r.text.encode()).hexdigest() for r in got if "漢" in r.text or "é" in r.text or "字" in r.text
    }


def test_empty_table(spark):
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _block(texts):
    ids = list(range(len(texts)))
    return suffix_dedup.Block(pa.table({"id_": pa.array(ids, pa.int64()), "text_": texts}))


def test_pieces_of_a_block_are_grouped_by_their_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    passages = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(12)]
    texts = ["".join(passages[i] for i in rng.integers(0, 12, 5)) + "x" * 90 for _ in range(40)]
    block = _block(texts)
    keys, counts = block.anchors()
    found = [block.fragments(counts > 1, counts > 30)]
    # Two texts of one mark: the bytes decide.
    monkeypatch.setattr(suffix_dedup, "_marks", lambda view, begin, size: np.zeros(len(begin), np.uint64))
    found.append(block.fragments(counts > 1, counts > 30))
    text = block.text.tobytes()
    for (begin, size, doc), which, (key, width, least, first) in found:
        pieces = [text[a : a + n + 49] for a, n in zip(begin, size)]
        kept = [text[a : a + n + 49] for a, n in zip(first, width)]
        assert len(set(kept)) == len(kept) == len(set(pieces)) and [kept[w] for w in which] == pieces
        assert (np.diff(key.astype(np.int64)) >= 0).all()
        assert all(least[w] == min(d for x, d in zip(which, doc) if x == w) for w in range(len(kept)))


def test_runs_do_not_depend_on_the_chunk(monkeypatch):
    texts = ["ab" * 60, "", "q" * 49, "r" * 50, "some words of a text that is long enough to hold runs " * 9, "é" * 200]
    wide = _block(texts)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    narrow = _block(texts)
    assert all((getattr(wide, x) == getattr(narrow, x)).all() for x in ("begin", "size", "key", "row"))
    assert wide.size.sum() == np.maximum(wide.lengths - 49, 0).sum()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_wanted_suffixes_only(alphabet, monkeypatch):
    rng = random.Random(3)
    text = np.frombuffer("".join(rng.choice(alphabet) for _ in range(900)).encode(), np.uint8)
    wanted = np.zeros(900, bool)
    wanted[np.arange(0, 900, 45)[:, None] + np.arange(10)] = True
    held = []
    directly = suffix_array._sort_directly
    monkeypatch.setattr(suffix_array, "_sort_directly", lambda positions, view: held.append(len(positions)) or directly(positions, view))
    order = suffix_order(text, None, wanted)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    raw = text.tobytes() + bytes(DEPTH)
    keys = [raw[i : i + 50] for i in order]
    assert keys == sorted(keys)
    suffix_order(text)
    assert held[0] <= max(held[1] // 2, 0)


def test_one_fragment_of_an_anchor_is_not_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    same = ["".join(rng.choice(list("abcdefgh "), 80)).encode() for _ in range(40)]
    other = ["".join(rng.choice(list("abcdefgh "), 70)).encode() for _ in range(30)]
    texts = same * 3 + [t + b"x" for t in other] + [t + b"y" for t in other]
    key = np.array([i % 40 for i in range(120)] + [100 + i % 30 for i in range(60)], np.uint32)
    doc = rng.integers(0, 1000, len(texts))
    size = np.array([len(t) - 49 for t in texts])
    met, earliest = [], suffix_dedup.earliest
    monkeypatch.setattr(suffix_dedup, "earliest", lambda some, docs: met.extend(some) or earliest(some, docs))
    which, (first, values, lengths) = suffix_dedup._least_by_fragment(key, size, doc, np.frombuffer(b"".join(texts), np.uint8))
    assert sorted(met) == sorted(texts[120:])
    least = {}
    for text, d in zip(texts, doc):
        for p in range(len(text) - 49):
            least[text[p : p + 50]] = min(d, least.get(text[p : p + 50], d))
    for text, w in zip(texts, which):
        runs = slice(first[w], first[w + 1])
        assert np.repeat(values[runs], lengths[runs]).tolist() == [least[text[p : p + 50]] for p in range(len(text) - 49)]
