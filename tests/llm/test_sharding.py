"""Sharding: even shards, the mixture in each, a fixed order, and every awkward row."""

import zlib
from collections import Counter, defaultdict

import pytest

from gaugewatch.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard_ int, key_ string"


def docs_of(spark, n, hot="web"):
    rows = [(i, f"text {i % 37}", hot if i % 3 else f"site{i % 11}", i, None) for i in range(n)]
    rows += [(None, None, None, 1, "k"), (None, None, None, 1, "k"), (7, "", "lone", 1, "k"), (7, "", "lone", 2, "other"), (8, "é\n", "x" * 300, 0, "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def verify(rows, expected, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))


def digest_of(rows):
    return Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


@pytest.mark.parametrize("range_rows", [10_000, 50])
def test_even_and_mixed(spark, range_rows):
    docs, rows = docs_of(spark, 1200)
    dealt = sharding.assign(docs, ["source"], 8, range_rows=range_rows).collect()
    verify(dealt, digest_of(rows), 8)
    per_source = defaultdict(Counter)
    for r in dealt:
        per_source[r.row_.source][r.shard] += 1
    for counts in per_source.values():
        share = sum(counts.values()) / 8
        assert all(abs(counts[s] - share) < 2 for s in range(8))


def test_ranges_do_not_change_the_order(spark):
    docs, _ = docs_of(spark, 500)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.shard, r.slot)
    runs = [sharding.assign(d, [], 4, range_rows=n).collect() for d, n in ((docs, 10_000), (docs.repartition(7), 40))]
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))


def test_brute_force(spark):
    import hashlib

    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16)
    docs, rows = docs_of(spark, 300)
    strata = defaultdict(list)
    for doc_id, text, source, *_ in rows:
        name = "n" if source is None else "s" + source
        key = number(f"7/{'none' if doc_id is None else doc_id}/{'n' if text is None else 't' + text}")
        strata[name].append((key, -1 if doc_id is None else doc_id))
    order = []
    for name, own in strata.items():
        for r, (key, doc_id) in enumerate(sorted(own)):
            order.append(((r + number("7/" + name) / 16**13) / len(own), name, key, doc_id))
    order.sort()
    n = len(order)
    expected = [(doc_id, p * 8 // n, p - -(-(p * 8 // n * n) // 8)) for p, (_, _, _, doc_id) in enumerate(order)]
    got = [(-1 if r.doc_id is None else r.doc_id, r.shard, r.slot) for r in sharding.assign(docs, [], 8, range_rows=64).collect()]
    assert sorted(expected) == sorted(got)


def test_whole_rows_and_files(spark, tmp_path):
    docs, rows = docs_of(spark, 100)
    out = sharding.sharded(docs, 3)
    assert out.columns == [*docs.columns, "shard__", "slot_"]  # the table has a column shard_
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(rows)
    sharding.write_shards(docs, str(tmp_path / "s"), 3, file_rows=10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.groupBy("shard__", "file_").count().agg({"count": "max"}).first()[0] == 10


def test_few_and_no_rows(spark):
    docs, _ = docs_of(spark, 0)
    assert sharding.digest(docs.limit(0)).collect() == []
    verify(sharding.digest(docs.limit(3)).collect(), digest_of([tuple(r) for r in docs.limit(3).collect()]), 8)
    assert {r.law for r in sharding.digest(docs).collect()} == {"rows"}


def test_seed_changes_the_order(spark):
    docs, _ = docs_of(spark, 200)
    one, two = ({(r.doc_id, r.size): (r.shard, r.slot) for r in sharding.assign(docs, [], 8, seed=s).collect()} for s in (1, 2))
    assert one != two
