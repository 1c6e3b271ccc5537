"""Packing: round trip of ids, the bound, and the exchange between parts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewatch.llm import packing
from gaugewatch.llm.tokens import default_file, encoder

TEXTS = [
    (1, "Hello world, it's 12 o'clock.\n\n  Next  line"), (2, None), (3, ""), (4, "naïve Ünï 漢字 🙂 " * 700),
    (4, "same id"), (None, "no id"), (None, "no id"), (7, "a"), (8, "x<|endoftext|>y"), (9, " \n\t  "),
]


TOKENIZER = Tokenizer.from_file(default_file()[0])


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def docs_of(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, length int, bin string")
    return df


def verify(rows, texts, length):
    whole = defaultdict(int)
    for _, text in texts:
        whole[len(ids_of(text))] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    expected = []
    for doc_id, text in texts:
        ids = np.array(ids_of(text), "<u4")
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), length)):
            expected.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, expected)) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)


def test_pieces_cover_every_document(spark):
    for length in (64, 2048):
        rows = packing.pack(docs_of(spark, TEXTS), length=length).collect()
        verify(rows, TEXTS, length)


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, TEXTS).limit(0)).count() == 0


def test_parts_exchange(spark):
    texts = [(i, "word " * (5 + 7 * i % 50)) for i in range(300)]
    few = packing.pack(docs_of(spark, texts), length=64, part_pieces=20).collect()
    verify(few, texts, 64)
    one = packing.pack(docs_of(spark, texts), length=64).collect()
    assert len({r.sequence_id for r in few}) <= len({r.sequence_id for r in one}) * 1.2


@pytest.mark.parametrize("seed", range(5))
def test_bound_is_below_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 200)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    bound = packing.lower_bound(np.bincount(lengths, minlength=65), 64)
    assert -(-lengths.sum() // 64) <= bound <= bins.max() + 1 <= bound * 11 / 9 + 1


def test_bound_counts_items_that_share_nothing():
    assert packing.lower_bound(np.bincount([40] * 10, minlength=65), 64) == 10


def test_ids_are_those_of_the_file(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    own = encoder(*default_file())
    for text in [*texts, *(t or "" for _, t in TEXTS)]:
        assert own.encode(text).tolist() == ids_of(text)[:-1]


def test_a_round_that_saves_nothing_is_discarded(spark, monkeypatch):
    """Later rounds that give every piece a sequence of its own are not taken."""
    texts = [(i, "word " * (5 + 7 * i % 50)) for i in range(300)]
    honest, first = packing._pack, []

    def worse(rows, parts, salt, capacity):
        packed = honest(rows, parts, salt, capacity)
        if salt:
            return packed.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
        first.append(packed.select("part", "bin").distinct().count())
        return packed

    monkeypatch.setattr(packing, "_pack", worse)
    rows = packing.pack(docs_of(spark, texts), length=64, part_pieces=20).collect()
    verify(rows, texts, 64)
    assert len({r.sequence_id for r in rows}) == first[0]
