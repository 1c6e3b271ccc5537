"""Each stage of the pipeline on what the stage before it kept."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_jaccard_join import brute as components
from test_packing import verify
from test_suffix_dedup import brute as repeats

import corpus_pipeline
from gaugewatch.llm import decontaminate

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, with nulls, empty texts, repeated rows and another column added."""
    at = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", at)
    docs = pq.read_table(f"{SMALL}/documents.parquet")
    more = docs.slice(0, 4).to_pylist()
    more[0]["text"], more[1]["text"], more[2]["doc_id"] = None, "", None
    docs = pa.concat_tables([docs, docs.slice(10, 3), pa.Table.from_pylist(more, docs.schema)])
    pq.write_table(docs.append_column("score", pa.array([1.5] * len(docs))), f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    named = {name: [(r.doc_id, r.text) for r in rows] for name, rows in kept.items() if name != "best_fit_packing"}
    assert set(named["quality_classifier"]) <= set(before) and len(named["quality_classifier"]) > 150
    own = {d for d, n, c in components(named["quality_classifier"]) if d == c}
    assert {d for d, _ in named["ngram_jaccard_join"]} - {None} == own - {None}
    # An id may have several rows: what is left of them is compared in the order of its size.
    left = lambda sizes: sorted(sizes, key=lambda r: (r[0] is not None, r))
    want = left((d, n - removed) for d, n, removed, _, _ in repeats(named["ngram_jaccard_join"]))
    got = left((d, len((text or "").encode())) for d, text in named["suffix_array_dedup"])
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(size - 6 <= own <= size for (_, own), (_, size) in zip(got, want, strict=True))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    index = decontaminate.Index.build(items, decontaminate.GRAM, decontaminate.EDITS)
    clean = [row for row in named["suffix_array_dedup"] if not decontaminate.find(index, [row[1]])[0]]
    assert sorted(named["benchmark_decontamination"], key=str) == sorted(clean, key=str)
    verify(kept["best_fit_packing"], clean, 2048)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
