"""Held-out accuracy of the two text classifiers, and their odd cases."""

import numpy as np
import pytest

from gaugewatch.llm import compression_quality, toxicity
from gaugewatch.llm.common import labelled_sample, table
from gaugewatch.llm.queries import op2_toxicity, op9_compression_quality

SF_DIR = "/root/testdata/sf0.1"


def auc(y, score):
    order = np.argsort(np.argsort(score)) + 1
    positive = y == 1
    return (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


@pytest.mark.parametrize(
    ("query", "label", "least", "threshold"), [(op2_toxicity, "toxic", 0.97, 0.5), (op9_compression_quality, "quality", 0.95, 0.3)]
)
def test_held_out(spark, query, label, least, threshold):
    scored = query(spark, SF_DIR)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.toPandas()
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= threshold)).all()
    named = rows.merge(table(spark, SF_DIR, "labels").toPandas(), on="doc_id")
    own = named[named.held_out]
    assert 100 < len(own) < len(named) / 4
    assert auc(own[label].to_numpy(), own.score.to_numpy()) > least
    assert (own.predicted == own[label]).mean() > least - 0.02


ODD = [(1, None), (2, ""), (3, " \n"), (4, "!!! ..."), (None, "some text"), (None, "some text"), (5, "word " * 50_000), (6, "漢字" * 9)]


@pytest.mark.parametrize("module", [compression_quality, toxicity])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(i, t, 2.0, "x") for i, t in ODD], "doc_id long, text string, score double, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        model = module.fit(docs, labels)
        scored = module.score(docs, model)
        assert sorted(scored.columns) == sorted(docs.columns)
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.text == "some text"}) == 1
    assert module.score(docs.limit(0), model).count() == 0


def test_kept_documents_are_as_they_were(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = compression_quality.fit(docs, table(spark, "/root/testdata/sf0.001", "labels"))
    kept = compression_quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert set(kept.collect()) <= set(docs.collect())
    named = docs.withColumnRenamed("source", "quality_score_")
    same = compression_quality.keep_good(named, model)
    assert same.columns == named.columns and set(same.collect()) == set(kept.collect())


def test_training_is_repeatable():
    sample = [("good " * (i % 5 + 2) + ("idiot clown" if i % 3 == 0 else "fine day"), int(i % 3 == 0)) for i in range(200)]
    a, b = toxicity.train(sample, 0.3), toxicity.train(sample, 0.3)
    texts = [b"what an idiot clown", b"a good fine day", b""]
    assert a.scores(texts).tolist() == b.scores(texts).tolist()
    assert a.scores(texts)[0] > 0.5 > a.scores(texts)[1]


def test_network_by_plain_loops():
    """Every step of the forward pass again: words, stems, sums of embeddings, filters, pooling, output."""
    sample = [("good " * (i % 5 + 2) + ("idiotically clownish" if i % 3 == 0 else "wonderfully fine"), int(i % 3 == 0)) for i in range(200)]
    model = toxicity.train(sample, 0.3)
    texts = ["a good idiotically wonderful day", "clownish!! CLOWNISHNESS", "", "of", "good " * 40, "der Tag und die Nacht"]
    for text, got in zip(texts, model.scores([t.encode() for t in texts]), strict=True):
        words = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in text).lower().split()
        rows = []
        for word in words:
            raw = word.encode()
            own = int(toxicity.buckets([raw])[0][0, 0])
            stems = [int(toxicity.buckets([raw])[0][0, 1 + k]) for k, n in enumerate(toxicity.STEMS)]
            assert all((stem == own) == (len(raw) <= n) for stem, n in zip(stems, toxicity.STEMS, strict=True))
            rows.append([int(np.flatnonzero(model.known == b)[0]) + 1 if b in model.known else 0 for b in (own, *stems)])
        hidden = []
        for n, (width, places) in enumerate(zip(toxicity.WIDTHS, model.response, strict=True)):
            for f in range(toxicity.FILTERS):
                # Windows may begin at every word and at the place behind the last one.
                value = max(
                    sum(float(places[k][r, f]) for k in range(width) for r in (rows[at + k] if at + k < len(rows) else [0]))
                    for at in range(len(rows) + 1)
                )
                hidden.append(max(value + float(model.bias[n * toxicity.FILTERS + f]), 0.0))
        logit = sum(h * float(o) for h, o in zip(hidden, model.out, strict=True)) + model.constant
        votes = [sum(w in listed.split() for w in words) for listed in toxicity.FUNCTION_WORDS.values()]
        threshold = model.threshold[votes.index(max(votes))]
        assert got == pytest.approx(1 / (1 + np.exp(-model.scale * (logit - threshold))), abs=1e-4)


def test_stems_carry_over_to_unseen_forms():
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    sample = [(f"one two {'vilest' if i % 3 == 0 else 'calmer'}{ends[i % 40]} three", int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train(sample, 0.33)
    assert (model.scores([f"one two vilest{e} three".encode() for e in ends[40:]]) > 0.5).all()
    assert (model.scores([f"one two calmer{e} three".encode() for e in ends[40:]]) < 0.5).all()


def test_an_id_with_both_labels_counts_as_one(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i in range(40) for k in (0, 1) if k == 0 or i % 2], "doc_id long, toxic int").repartition(7)
    got = dict(labelled_sample(docs, labels, "toxic", 100))
    assert got and all(y == int(t.split()[1]) % 2 for t, y in got.items())


def test_bytes_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 100, 1000)
    assert [sum(len(t) for t, y in got if y == k) for k in (0, 1)] == [1000, 1000]


def test_quality_does_not_depend_on_the_cap(spark):
    """Calibrated to the share of all labels: a capped sample keeps what a whole one keeps."""
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").limit(2000).collect()]
    whole, capped = (compression_quality.fit(docs, labels, n) for n in (3000, 450))
    assert whole.prior == pytest.approx(capped.prior, abs=0.01)
    a, b = (compression_quality.scores(m, texts) for m in (whole, capped))
    least = compression_quality.THRESHOLD
    assert abs(a.mean() - b.mean()) < 0.03
    assert ((a >= least) == (b >= least)).mean() > 0.97


def test_toxicity_thresholds_are_those_of_the_corpus():
    """A word that 3 of 10 texts with it are toxic for is clean, though the capped classes show 8 of 10."""
    rng = np.random.default_rng(3)
    filler = "one two three four five six seven eight nine ten".split()
    text = lambda word: " ".join([*rng.choice(filler, 6), word, *rng.choice(filler, 6)])
    sample = [(text(w), y) for w, y, n in (("vile", 1, 300), ("odd", 1, 300), ("odd", 0, 78), ("calm", 0, 522)) for _ in range(n)]
    model = toxicity.train([sample[i] for i in rng.permutation(len(sample))], 0.1)
    texts = {w: model.scores([text(w).encode() for _ in range(50)]) for w in ("vile", "odd", "calm")}
    assert (texts["vile"] > 0.5).mean() > 0.9
    assert (texts["odd"] < 0.5).mean() > 0.9 and (texts["calm"] < 0.5).mean() > 0.9
