"""Tokens of each section of a document, from one encoding of the whole document.

A document is encoded once, as a whole; sections are never encoded on their
own, as that would change the tokens at their borders. Each token has a span
of characters: from the character of its first byte to the one of its last (a
byte-level token may hold part of a character). Spans and sections meet in a
sorted interval join inside the row. A token that lies in several sections is
allocated by an explicit rule:

* ``first``: to the section that holds its first character,
* ``last``: to the section that holds its last character,
* ``most``: to the section that holds most of its characters, the first of equals.

A token without a section (where sections leave gaps) is counted in a row whose
section is -1. Sections are ascending and do not overlap. Counts of a document
add up to its number of tokens.

Null text is empty: a single section from 0 to 0 without tokens. Repeated rows
give repeated results, an empty table an empty one; a null id stays null.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.llm.common import batches
from gaugewatch.llm.tokens import default_file, encoder

Sections = Callable[[str], list[tuple[int, int]]]

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_shared long"
RULES = ("first", "last", "most")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Each line with its line feed is a section; an empty text is one empty section."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out or [(0, 0)]


def spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of every token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return character[ends - lengths[ids]], character[ends - 1] + 1


def allocate(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it touches several sections or a gap."""
    lows = np.array([a for a, _ in sections], np.int64)
    highs = np.array([b for _, b in sections], np.int64)
    # Sections that overlap a span: from the first that ends behind its start
    # to the last that begins before its end.
    first = np.searchsorted(highs, start, "right")
    last = np.searchsorted(lows, end, "left") - 1
    none = first > last
    inside = ~none & (first == last) & (lows[np.minimum(first, len(lows) - 1)] <= start) & (end <= highs[np.minimum(first, len(lows) - 1)])
    to = np.where(none, -1, last if rule == "last" else first)
    if rule == "most":
        for i in np.flatnonzero(~none & (first < last)):
            held = [min(end[i], highs[s]) - max(start[i], lows[s]) for s in range(first[i], last[i] + 1)]
            to[i] = first[i] + int(np.argmax(held))
    return to, ~inside


def attribute(
    docs: DataFrame, sections: Sections = line_sections, rule: str = "most", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_shared); no shuffle.

    ``n_shared`` counts those of the section's tokens that reach beyond it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if path is None:
        path, pattern = default_file()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, pattern)
        for batch in batches(source, 4 << 20):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                parts = sections(text)
                ids = model.encode(text)
                if len(ids):
                    to, shared = allocate(*spans(text, ids, model.lengths), parts, rule)
                    counts = np.bincount(to + 1, minlength=len(parts) + 1)
                    crossing = np.bincount(to + 1, weights=shared, minlength=len(parts) + 1).astype(np.int64)
                else:
                    counts = crossing = np.zeros(len(parts) + 1, np.int64)
                if counts[0]:
                    out.append((doc_id, -1, None, None, int(counts[0]), int(crossing[0])))
                out += [
                    (doc_id, k, a, b, n, m)
                    for k, ((a, b), n, m) in enumerate(zip(parts, counts[1:].tolist(), crossing[1:].tolist(), strict=True))
                ]
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return rows.mapInArrow(run, SCHEMA)
