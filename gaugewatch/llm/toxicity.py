"""Toxicity of a text by a small convolutional network over hashed word embeddings.

Words, and the first bytes of longer words, are hashed into buckets; the buckets
that occur in several training texts have an embedding, all others are zero, and
a word's embedding is the sum over its buckets. So forms of a word that training
did not see share what is known of their stem. Filters of several widths run
over the whole text, each keeps its largest response (max pooling), and a
linear layer adds them up. The network is trained in NumPy with Adam on a
bounded sample of labelled texts (labelled_sample), most of it; on the rest, a
logistic regression with an offset per language turns responses into
probabilities, every label counting as often as its class does in the corpus,
whatever the bound took from either class. So 0.5 is the threshold of each
language, and equal scores mean the same in all of them. The language is guessed
from function words of the text alone.

A null or empty text, or one without words, has only zero responses and gets
the score of those. Repeated rows get equal scores; a table without rows
gives none, and a table without labels the prior 0.5.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.llm.common import as_bytes, batches, held_out, labelled_sample
from gaugewatch.llm.shingles import prefix_hashes

BUCKETS = 1 << 22
STEMS = (5, 7)
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
MIN_TEXTS = 3
EPOCHS = 16
BATCH = 64
RATE = 0.01
DECAY = 1e-4
DROP = 0.3
OFFSET_PENALTY = 2.0
SAMPLE_PER_CLASS = 4000
CHUNK = 1 << 20
PAD = max(WIDTHS) - 1

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with are this was",
    "de": "der die das und ist nicht ein von mit den sich auf",
    "fr": "le les des est du un dans pour qui par sur au et",
    "es": "el los las del y que en por para con una es",
}
# ASCII bytes that are neither letters nor digits separate words.
SEPARATE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (its own and those of its stems), and the number of its text."""
    values, owner = prefix_hashes([t.translate(SEPARATE) for t in texts], STEMS)
    return (np.stack(values, 1) >> np.uint64(64 - 22)).astype(np.int64), owner


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(int(buckets([w.encode()])[0][0, 0]), n) for n, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()]
    found = np.unique([b for b, _ in pairs])
    table = np.zeros((len(found) + 1, len(FUNCTION_WORDS)))
    for b, n in pairs:
        table[np.searchsorted(found, b), n] += 1
    return found, table


def languages(bucket: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Number of the guessed language of each text; the first one where no word tells."""
    known, table = _language_table()
    bucket = bucket[:, 0]
    at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
    hit = known[at] == bucket
    votes = np.zeros((count, table.shape[1]))
    np.add.at(votes, owner[hit], table[at[hit]])
    return votes.argmax(1)


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """Trained buckets, what each filter makes of a bucket by place, output weights, calibration."""

    known: np.ndarray
    response: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    constant: float
    threshold: np.ndarray
    scale: float

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bucket, owner = buckets(texts)
        row = _rows_of(bucket, self.known)
        padded, starts = _padded(row, owner, len(texts))
        # As in training, windows begin at a text's words and one place behind: later ones would meet the next text.
        spans = np.c_[starts, np.r_[starts[1:], len(padded)] - PAD].ravel()
        pooled = []
        for width, places in zip(WIDTHS, self.response, strict=True):
            h = _summed(places[0], padded)
            for k in range(1, width):
                h[:-k] += _summed(places[k], padded[k:])
            pooled.append(np.maximum.reduceat(h, spans, 0)[::2])
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        return hidden @ self.out + self.constant, languages(bucket, owner, len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        logit, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(self.scale * (logit - self.threshold[language]), -30, 30)))


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of a word's rows. A short word's stems are the word again: counted once more, in training as well."""
    out = table[rows[:, 0]]
    for column in rows.T[1:]:
        out += table[column]
    return out


def _rows_of(bucket: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Row in the table of embeddings; 0 is the zero row of unknown buckets."""
    if not len(known):
        return np.zeros(bucket.shape, np.int64)
    at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
    return np.where(known[at] == bucket, at + 1, 0)


def _padded(row: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each behind itself with zeros, so no window meets two; and their starts."""
    n = np.bincount(owner, minlength=count)
    starts = np.cumsum(n + PAD + 1) - n - PAD - 1
    out = np.zeros((int((n + PAD + 1).sum()), row.shape[1]), np.int32)
    out[np.arange(len(row)) + np.repeat(np.arange(count) * (PAD + 1), n)] = row
    return out, starts


class _Adam:
    def __init__(self, values: list[np.ndarray]):
        self.values, self.step = values, 0
        self.first = [np.zeros_like(v) for v in values]
        self.second = [np.zeros_like(v) for v in values]

    def update(self, touched: np.ndarray, gradients: list[np.ndarray], rate: float) -> None:
        """One step. The first gradient is that of the ``touched`` rows of the first value; its other rows rest."""
        self.step += 1
        places = [touched, *[slice(None)] * (len(gradients) - 1)]
        for value, m, v, g, at in zip(self.values, self.first, self.second, gradients, places, strict=True):
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.001 * (g * g - v[at])
            value[at] -= rate * (m[at] / (1 - 0.9**self.step)) / (np.sqrt(v[at] / (1 - 0.999**self.step)) + 1e-8) + rate * DECAY * value[at]


def train(sample: list[tuple[str, int]], prior: float, seed: int = 7) -> ToxicityModel:
    """Network on four fifths of the sample, thresholds on the rest. ``prior``: share of toxic texts."""
    rng = np.random.default_rng(seed)
    y = np.array([v for _, v in sample], np.float32)
    rest = np.arange(len(sample)) % 5 == 0
    learn = np.flatnonzero(~rest)
    # Numbers of 22 bits: the sample's words stay small on the driver.
    rows = {i: buckets([sample[i][0].encode()])[0].astype(np.int32) for i in learn.tolist()}
    seen, times = np.unique(np.concatenate([np.unique(b) for b in rows.values()] + [np.zeros(0, np.int32)]), return_counts=True)
    known = seen[times >= MIN_TEXTS].astype(np.int64)
    for i, b in rows.items():
        rows[i] = _rows_of(b, known).astype(np.int32)
    embedding = (rng.normal(0, 0.1, (len(known) + 1, SIZE))).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    bias = np.zeros(total, np.float32)
    out = rng.normal(0, 0.3, total).astype(np.float32)
    constant = np.zeros(1, np.float32)
    adam = _Adam([embedding, *filters, bias, out, constant])
    weight = _weights(y, prior)
    if len(set(y[learn].tolist())) == 2:
        for epoch in range(EPOCHS):
            rng.shuffle(learn)
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for a in range(0, len(learn), BATCH):
                pick = learn[a : a + BATCH]
                touched, gradients = _gradients([rows[i] for i in pick], y[pick], weight[pick], embedding, filters, bias, out, constant, rng)
                adam.update(touched, gradients, rate)
                embedding[0] = 0
    response = [[embedding @ f[k] for k in range(len(f))] for f in filters]
    model = ToxicityModel(known, response, bias, out, float(constant[0]), np.zeros(len(FUNCTION_WORDS)), 1.0)
    return _calibrated(model, [sample[i][0].encode() for i in np.flatnonzero(rest)], y[rest], _weights(y, prior, 1.0)[rest])


def _weights(y: np.ndarray, prior: float, power: float = 0.5) -> np.ndarray:
    """Classes by how far the sample is from the corpus: its square root to learn, all of it (1) to count errors; mean 1."""
    share = max(float(y.mean()) if len(y) else 0.5, 1e-6)
    w = np.where(y == 1, prior / share, (1 - prior) / max(1 - share, 1e-6)) ** power
    return (w / max(w.mean(), 1e-9) if len(w) else w).astype(np.float32)


def _gradients(rows, y, weight, embedding, filters, bias, out, constant, rng) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of the embedding that pooling chose, and all gradients, that of these rows first."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    padded, starts = _padded(np.concatenate(rows), owner, len(rows))
    ends = np.r_[starts[1:], len(padded)]
    # One product for all filters and places of words in them.
    answers = _summed(embedding, padded) @ np.concatenate([f[k] for f in filters for k in range(len(f))], 1)
    pooled, places, column = [], [], 0
    for width in WIDTHS:
        h = answers[:, column : column + FILTERS].copy()
        for k in range(1, width):
            h[:-k] += answers[k:, column + k * FILTERS : column + (k + 1) * FILTERS]
        column += width * FILTERS
        places.append(np.array([a + h[a : e - PAD].argmax(0) for a, e in zip(starts, ends, strict=True)]))
        pooled.append(np.take_along_axis(h, places[-1], 0))
    before = np.concatenate(pooled, 1) + bias
    keep = (rng.random(before.shape) >= DROP).astype(np.float32) / (1 - DROP)
    hidden = np.maximum(before, 0) * keep
    p = 1 / (1 + np.exp(-np.clip(hidden @ out + constant, -30, 30)))
    error = (p - y) * weight / len(y)
    back = error[:, None] * out * keep * (before > 0)
    g_filters, words, g_words = [], [], []
    for n, (f, at) in enumerate(zip(filters, places, strict=True)):
        own = back[:, n * FILTERS : (n + 1) * FILTERS]
        g = np.zeros_like(f)
        for k in range(len(f)):
            word = padded[at + k]
            g[k] = np.einsum("nfd,nf->df", embedding[word].sum(2), own)
            part = own[:, :, None] * f[k].T[None]
            words.append(word.ravel())
            g_words.append(np.repeat(part.reshape(-1, SIZE), word.shape[2], 0))
        g_filters.append(g)
    word, g_word = np.concatenate(words), np.concatenate(g_words)
    order = np.argsort(word, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
    g_embedding = np.add.reduceat(g_word[order], first, 0)
    return word[order][first], [g_embedding, *g_filters, back.sum(0), hidden.T @ error, np.array([error.sum()], np.float32)]


def _calibrated(model: ToxicityModel, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Slope, constant and an offset per language by Newton's method; few labels of a language give a small offset."""
    if not texts or len(set(y.tolist())) < 2:
        return model
    # A bounded number of texts at a time.
    parts = [model.logits(texts[a : a + 64]) for a in range(0, len(texts), 64)]
    logit, language = (np.concatenate(x) for x in zip(*parts, strict=True))
    middle, spread = float(logit.mean()), float(logit.std()) or 1.0
    x = np.c_[(logit - middle) / spread, np.ones(len(y)), np.eye(len(FUNCTION_WORDS))[language]]
    penalty = np.r_[0.05, 1e-6, np.full(len(FUNCTION_WORDS), OFFSET_PENALTY)]
    values = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ values, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * values
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        values -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(values[0]), 1e-3) / spread
    return dataclasses.replace(model, threshold=middle - (values[1] + values[2:]) / slope, scale=slope)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled texts of each class, outside the held-out fold."""
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train(labelled_sample(docs, labels, "toxic", per_class), 0.5 if prior is None else float(prior))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text; no shuffle. A column ``to`` is replaced."""
    wide = docs.select(*[docs[c] for c in docs.columns if c != to])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by the training sample
    schema = T.StructType([*wide.schema.fields, T.StructField(to, T.DoubleType())])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, CHUNK, text):
            values = shared.value.scores(as_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.astype(np.float64))], [*batch.schema.names, to])

    return wide.mapInArrow(run, schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
