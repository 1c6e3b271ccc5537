"""Decontamination against a full alignment table of every item with every document."""

import random

import numpy as np
import pytest

from gaugewatch.llm import decontaminate as dec

Q, SHARE = 4, 0.15


def plain(text):
    return " ".join(text.lower().split()) if text else ""


def fewest(item, text):
    """Edits of the best alignment of the item with any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edit(rng, text, count):
    out = list(text)
    for _ in range(count):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "#"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "~")
    return "".join(out)


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(i, prose(rng.randint(4, 16)).strip()) for i in range(10)] + [(20, "xyz"), (None, prose(9)), (3, None), (4, "")]
    docs = [(i, prose(rng.randint(0, 60))) for i in range(15)] + [(100, None), (101, ""), (None, items[0][1]), (150, items[1][1]), (150, items[1][1])]
    docs += [(102, "wxyz xyz"), (103, items[2][1].upper().replace(" ", "\n  ")), (104, items[3][1] + " " + items[3][1])]
    for i, (_, text) in enumerate(items[:10]):
        for k in range(6):
            docs.append((200 + 10 * i + k, prose(k) + " " + edit(rng, text, k * len(text) // 30) + " " + prose(3)))
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(3),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


@pytest.mark.parametrize("index_chars", [10**6, 60])
def test_against_full_alignment(spark, index_chars):
    docs, items = corpus(index_chars)
    got = dec.matches(*frames(spark, docs, items), share=SHARE, q=Q, index_chars=index_chars).collect()
    found = sorted({(r.doc_id, r.item_id) for r in got}, key=str)
    want, texts = set(), {}
    for doc_id, text in docs:
        for item_id, item in items:
            if plain(text) and plain(item):
                texts.setdefault((doc_id, item_id), []).append((text, item))
                if fewest(plain(item), plain(text)) <= int(SHARE * len(plain(item))):
                    want.add((doc_id, item_id))
    assert found == sorted(want, key=str)
    assert sum(r.doc_id == 150 and r.item_id == 1 for r in got) == 2
    for r in got:
        ok = False
        for text, item in texts[(r.doc_id, r.item_id)]:
            part = plain(text[r.start : r.end])
            ok |= r.edits <= SHARE * len(item) and abs(len(part) - len(plain(item))) <= r.edits + 1 and fewest(plain(item), plain(text)) <= r.edits
        assert ok, r


def test_clean_drops_only_documents_with_items(spark):
    docs, items = corpus(1)
    a, b = frames(spark, docs, items)
    kept = dec.clean(a, b, share=SHARE, q=Q)
    assert kept.columns == a.columns
    hit = {r.doc_id for r in dec.matches(a, b, share=SHARE, q=Q).collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in hit)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(2))
    assert dec.matches(docs.limit(0), items).count() == 0
    assert dec.matches(docs, items.limit(0)).count() == 0
    assert dec.clean(docs, items.limit(0)).count() == docs.count()


def test_grams_are_those_of_the_text():
    points = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4] * 3, np.uint32)
    for q in (1, 2, 3, 5, 7, 8):
        value = dec.grams(points, q)
        names = [tuple(points[i : i + q]) for i in range(len(points) - q + 1)]
        assert len(value) == len(names)
        assert len(set(value.tolist())) == len(set(names)) == len(set(zip(value.tolist(), names)))


@pytest.mark.parametrize("length", [1, 5, 9, 10, 12, 19, 20, 29, 30, 39, 50, 74, 75, 90])
def test_every_length_has_the_promised_budget(length):
    """Copies with as many edits as a tenth of the length, evenly spread: the fewest shared q-grams."""
    item = "".join(chr(0x4E00 + i) for i in range(length))
    k = length // 10
    copy = list(item)
    for e in range(k):
        copy[(2 * e + 1) * length // (2 * k)] = "#"
    index = dec.Index.build([(7, item)], dec.GRAM, dec.EDITS)
    [hits, none] = dec.find(index, ["before " + "".join(copy) + " after", "#" + item[: length // 2] + "#"])
    assert [(h[0], h[3]) for h in hits] == [(7, k)]
    assert none == []


def test_own_columns_stay(spark):
    docs, items = frames(spark, *corpus(3))
    docs = docs.withColumnRenamed("item_id", "benchmark_matches_")
    assert dec.clean(docs, items, share=SHARE, q=Q).columns == ["doc_id", "text", "benchmark_matches_"]


def test_text_beyond_a_chunk():
    """A text of over 8 MB with an item at its end."""
    item = "which of these rivers crosses the border of the old town twice before the harbour"
    text = "plain words again " * 500_000 + item.replace("old", "odl")
    assert len(text) > 8 << 20
    [hits] = dec.find(dec.Index.build([(1, item)], dec.GRAM, dec.EDITS), [text])
    assert [(h[0], h[3]) for h in hits] == [(1, 2)] and text[hits[0][1] : hits[0][2]].startswith("which")
