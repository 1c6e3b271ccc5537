"""Quality of a text from how well dictionaries of good and of bad text compress it.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. Each text is cut into blocks (all of it, so that a long
text does not outgrow the dictionaries), each block is compressed with either
dictionary, and the sizes are added up. The normalised difference of the two
sizes, with the compression ratio that separates mere repetition from prose,
is turned into a probability by a logistic calibration on labelled texts which
no dictionary has seen. Each of these counts for as many labels of its class as
the bound of the sample left out, so the probability refers to the classes'
shares among all labels and not to those of the sample.

A null or empty text, or one of white space only, has no sizes; it gets the
share of good texts among all labelled ones. Repeated rows get equal scores.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.llm.common import as_bytes, batches, free_names, held_out, label_counts, labelled_sample

BLOCK = 2048
DICT_BYTES = 112_640
LEVEL = 3
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.3
CHUNK = 2 << 20


@dataclasses.dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or raw text where there is too little to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 8]
    if len(blocks) >= 100:
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(blocks)[:DICT_BYTES] or b"the text is empty"


class Sizer:
    """Compressed sizes of a text under both dictionaries and without one."""

    def __init__(self, good: bytes, bad: bytes):
        kinds = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        flags = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.with_dict = [
            zstandard.ZstdCompressor(dict_data=d, compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **flags))
            for d in kinds
        ]
        self.plain = zstandard.ZstdCompressor(
            compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **flags)
        )

    def features(self, text: bytes) -> tuple[float, ...]:
        good = bad = plain = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            good += len(self.with_dict[0].compress(block))
            bad += len(self.with_dict[1].compress(block))
            plain += len(self.plain.compress(block))
        n = len(text)
        difference = (bad - good) / (bad + good)
        return (difference, good / n, bad / n, plain / n, difference * difference, (plain / n) ** 2, np.log1p(min(n, BLOCK)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised, weighted likelihood; the intercept is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> QualityModel:
    """Dictionaries from two thirds of the sample, calibration on the rest.

    ``stands_for``: labels of the corpus for each sampled one, of the bad and of the good class.
    """
    texts = [(t.encode(), y) for t, y in sample if t and t.strip()]
    prior = (sum(stands_for[y] * y for _, y in texts) + 1) / (sum(stands_for[y] for _, y in texts) + 2)
    learn = [x for i, x in enumerate(texts) if i % 3]
    rest = [x for i, x in enumerate(texts) if not i % 3]
    good, bad = (_dictionary([t for t, y in learn if y == k]) for k in (1, 0))
    sizer = Sizer(good, bad)
    if len({y for _, y in rest}) < 2:
        width = len(sizer.features(b"text"))
        bias = float(np.log(prior / (1 - prior)))
        return QualityModel(good, bad, (0.0,) * width, (1.0,) * width, (0.0,) * width + (bias,), prior)
    x = np.array([sizer.features(t) for t, _ in rest])
    y = np.array([y for _, y in rest], float)
    # Mean 1, so that the penalty means the same at every size.
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = _fit_logistic((x - mean) / scale, y, weight / weight.mean())
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(weights), prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Learn from at most ``per_class`` labelled texts of each class (see labelled_sample); shares are of all labels."""
    counts = label_counts(labels, "quality")
    return train(labelled_sample(docs, labels, "quality", per_class), tuple(max(1.0, n / per_class) for n in counts))


def scores(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    sizer = Sizer(model.good, model.bad)
    out = np.full(len(texts), model.prior)
    some = [i for i, t in enumerate(texts) if t.strip()]
    if some:
        x = np.array([sizer.features(texts[i]) for i in some])
        x = (x - np.array(model.mean)) / np.array(model.scale)
        w = np.array(model.weights)
        out[some] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return out


def score(docs: DataFrame, model: QualityModel, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; no shuffle.

    A column that has the name ``to`` already is replaced.
    """
    kept = [c for c in docs.columns if c != to]
    wide = docs.select(*[docs[c] for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    schema = T.StructType([*wide.schema.fields, T.StructField(to, T.DoubleType())])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, CHUNK, text):
            values = scores(shared.value, as_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, to])

    return wide.mapInArrow(run, schema)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their own columns."""
    [to] = free_names(docs.columns, "quality_score_")
    return score(docs, model, to=to).where(F.col(to) >= threshold).drop(to)
