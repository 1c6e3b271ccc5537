"""Bytes that repeat a 50-byte string of an earlier document, found by suffix arrays.

Every 50-byte string has an anchor: the 16-byte gram in it with the smallest
hash. Equal strings have equal anchors, so strings are handled by runs that
share an anchor, about one run per 18 bytes.

1. Documents are dealt into blocks by hash. A block sends each of its anchors
   once, in 6 bytes, to the anchor's bucket; the bucket answers with two bits:
   is the anchor in another document, and is it hot?
2. A block cuts the runs of repeated anchors out of its texts as fragments,
   keeps distinct ones with their smallest document, and sends them to the
   bucket of the anchor. Runs of hot anchors are cut into single strings that
   go to the bucket of their own hash, so no anchor can fill a bucket.
3. A bucket joins its distinct fragments to one text, builds the suffix array
   by two-stage sorting, computes adjacent common prefixes, and takes the
   smallest document of each group of strings that agree in 50 bytes. These
   numbers go back to the blocks. Where all blocks sent one and the same
   fragment for an anchor, its strings are nowhere else: there is nothing to sort.
4. A block removes what an earlier document has.

A group of copies, however large, sends one fragment per block. The block's
answers are aligned with what it sent, so nothing is joined by text. Every
step repeats in the same way if its task is lost.

Null text is empty. Rows without an id count as later than all rows with one,
and rows with equal ids (or none) never remove each other's bytes; each input
row gives one result row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugewatch.llm.common import least_parts, parts_for, total_bytes
from gaugewatch.llm.suffix_array import WORD, common_prefixes, suffix_order, words

LENGTH = 50
GRAM = 16
RUN = 64
HOT = 1000
BLOCK_BYTES = 4 << 20
BUCKET_ANCHORS = 1 << 19
CHUNK = 1 << 16  # bytes whose arrays of numbers stay in a core's cache
LAST = np.iinfo(np.int64).max
PARTS = 16  # of a bucket, sorted one after the other
SEPARATOR = 0xFF  # no byte of UTF-8

RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_", "text_")
KINDS = {
    "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(),
    "kept_sha256": T.StringType(), "kept_": T.BinaryType(), "text_": T.StringType(),
}
SKETCH = "block_ long, bucket_ long, n_ long, keys_ binary, counts_ binary"
ANSWER = "block_ long, bucket_ long, kind_ int, a_ binary, b_ binary"
FRAGMENTS = "block_ long, bucket_ long, parts_ binary, keys_ binary, sizes_ binary, docs_ binary, bytes_ binary"


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    h = a >> np.uint64(32)
    h ^= a
    h *= np.uint64(0x9E3779B97F4A7C15)
    low = h >> np.uint64(29)
    h ^= low
    h ^= b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(32), out=low)
    h ^= low
    return h


def _runs(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, 48-bit anchor key) of the runs in concatenated documents."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    count = np.maximum(lengths - LENGTH + 1, 0)
    some = np.flatnonzero(count)
    if not len(some):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    view = words(text)
    n = len(text)
    word = view[: n + WORD].astype(np.uint64)
    # High bits depend on all sixteen bytes. What is equal here is one anchor, whatever the bytes.
    gram = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    gram += word[WORD : n + WORD] * np.uint64(0xBF58476D1CE4E5B9)
    # The smallest hash among the grams of each string, by doubling spans.
    least, span, need = gram, 1, LENGTH - GRAM + 1
    while span < need:
        step = min(span, need - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # A run begins where a document does or the anchor changes, and ends at the next one or with its document's strings.
    new = np.zeros(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[starts[some]] = True
    position = np.flatnonzero(new)
    stop = (starts + count)[np.searchsorted(ends, position, "right")]
    inside = position < stop
    size = np.minimum(np.r_[position[1:], len(least)], stop)[inside] - position[inside]
    position = position[inside]
    value = least[position]
    # Runs are cut to a bounded number of strings (texts of one byte repeated).
    parts = -(-size // RUN)
    which = np.repeat(np.arange(len(position)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = position[which] + nth * RUN
    size = np.minimum(size[which] - nth * RUN, RUN)
    return begin, size, _mix(value[which], np.uint64(0x51)) >> np.uint64(16)


class Block:
    """The documents of one block in a fixed order, with their runs."""

    def __init__(self, docs: pa.Table):
        ids = pc.fill_null(docs.column("id_"), LAST).to_numpy()
        texts = docs.column("text_").cast(pa.large_string()).cast(pa.large_binary()).combine_chunks()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        # Rows of one id go by their bytes.
        same = np.flatnonzero(self.ids[1:] == self.ids[:-1])
        if len(same):
            firsts = same[np.r_[True, np.diff(same) > 1]]
            for a, e in zip(firsts, same[np.r_[np.diff(same) > 1, True]] + 2, strict=True):
                rows = self.order[a:e].tolist()
                self.order[a:e] = sorted(rows, key=lambda i: texts[i].as_py() or b"")
        texts = texts.take(pa.array(self.order)).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.lengths = np.diff(offsets)
        self.text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.ends = np.cumsum(self.lengths)
        found = []
        # Documents are taken in chunks, so that the arrays of numbers stay small.
        chunk = (self.ends - self.lengths) // CHUNK
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(chunk)], strict=True):
            low, high = self.ends[a] - self.lengths[a], self.ends[b - 1]
            begin, size, key = _runs(self.text[low:high], self.lengths[a:b])
            found.append((begin + low, size, key))
        self.begin, self.size, self.key = (np.concatenate(x) for x in zip(*found, strict=True))
        self.row = np.searchsorted(self.ends, self.begin, "right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and how many runs have them; 1 means: in one document only."""
        order = self.by_key = np.argsort(self.key)
        key, doc = self.key[order], self.ids[self.row[order]]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        self.anchor = np.empty(len(key), np.int64)
        self.anchor[order] = np.cumsum(new) - 1  # of each run, its place among the distinct keys
        first = np.flatnonzero(new)
        if not len(first):
            return key, np.zeros(0, np.uint16)
        count = np.diff(np.r_[first, len(key)])
        single = np.minimum.reduceat(doc, first) == np.maximum.reduceat(doc, first)
        return key[first], np.where(single, 1, np.clip(count, 2, 60_000)).astype(np.uint16)

    def fragments(self, repeated: np.ndarray, hot: np.ndarray):
        """Pieces of repeated runs: (begin, size, key, doc) and the distinct fragments among them.

        The masks go by distinct keys, as ``anchors`` gives them. Returns pieces,
        the fragment of each piece, and for the fragments in the order of their
        keys: key, size, smallest document, and where one of them begins.
        """
        at = self.anchor
        pick = repeated[at] & ~hot[at]
        order = self.by_key[pick[self.by_key]]
        begin, size, key, row = self.begin[order], self.size[order], self.key[order], self.row[order]
        pick = repeated[at] & hot[at]
        if pick.any():
            which = np.repeat(np.flatnonzero(pick), self.size[pick])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(self.size[pick]) - self.size[pick], self.size[pick])
            single = self.begin[which] + nth
            view = words(self.text)
            value = view[single].astype(np.uint64)
            for depth in (8, 16, 24, 32, 40, 42):
                value = _mix(value, view[single + depth].astype(np.uint64))
            begin, row = np.r_[begin, single], np.r_[row, self.row[which]]
            size = np.r_[size, np.ones(len(single), np.int64)]
            key = np.r_[key, value >> np.uint64(16)]
            order = np.argsort(key)
            begin, size, key, row = begin[order], size[order], key[order], row[order]
        view = words(self.text)
        # The order among equal keys has to be the same in every run of this: by the bytes, then by place.
        tied = np.r_[False, key[1:] == key[:-1]][: len(key)]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        mark = np.zeros(len(key), np.uint64)
        mark[at] = _marks(view, begin[at], size[at])
        moved = at[np.lexsort((begin[at], mark[at], key[at]))]
        for x in (begin, size, key, row, mark):
            x[at] = x[moved]
        same = np.r_[False, (key[1:] == key[:-1]) & (mark[1:] == mark[:-1])][: len(key)]
        doubt = np.flatnonzero(same)
        equal = _equal(view, begin[doubt], size[doubt], begin[doubt - 1], size[doubt - 1])
        which = np.cumsum(~same) - 1 if equal.all() else _numbered(self.text, begin, size, key)
        doc = self.ids[row]
        first = np.unique(which, return_index=True)[1] if len(which) else which
        least = np.full(len(first), LAST, np.int64)
        np.minimum.at(least, which, doc)
        return (begin, size, doc), which, (key[first], size[first], least, begin[first])


def _numbered(text: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The number of each piece's text, in the order in which they are met: where two texts have one mark."""
    raw = text.tobytes()
    seen: dict[tuple, int] = {}
    told = [seen.setdefault((k, raw[a : a + n + LENGTH - 1]), len(seen)) for k, a, n in zip(key.tolist(), begin.tolist(), size.tolist())]
    return np.array(told, np.int64)


def _marks(view: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every piece, a word at a time."""
    mark = size.astype(np.uint64)
    for depth in (0, 8, 16, 24, 32, 40, LENGTH - WORD):
        mark = _mix(mark, view[begin + depth].astype(np.uint64))
    for depth in range(LENGTH, RUN + LENGTH - 1, WORD):
        # The last word of a piece ends with it.
        more = np.flatnonzero(size + LENGTH - 1 > depth)
        if not len(more):
            break
        last = np.minimum(depth, size[more] + LENGTH - 1 - WORD)
        mark[more] = _mix(mark[more], view[begin[more] + last].astype(np.uint64))
    return mark


def _equal(view: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether pieces are equal, byte by byte."""
    equal = m == n
    for depth in range(0, RUN + LENGTH - 1, WORD):
        more = np.flatnonzero(equal & (m + LENGTH - 1 > depth))
        if not len(more):
            break
        last = np.minimum(depth, m[more] + LENGTH - 1 - WORD)
        equal[more] = view[a[more] + last] == view[b[more] + last]
    return equal


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the key, so that the keys of a bucket are a slice."""
    return ((key >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(bucket):
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), int(a), int(b)


def _planes(key: np.ndarray) -> bytes:
    """Six bytes per key, byte by byte: ascending keys have nearly constant high bytes."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def _sketch(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        block = docs.column("block_")[0].as_py()
        keys, counts = Block(docs).anchors()
        return _rows(
            [(block, b, e - a, _planes(keys[a:e]), counts[a:e].tobytes()) for b, a, e in _slices(_bucket(keys, buckets))],
            SKETCH,
        )

    return run


def _count(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        blocks, bucket = rows.column("block_").to_pylist(), rows.column("bucket_")[0].as_py()
        keys = [_unplanes(k) for k in rows.column("keys_").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint16) for c in rows.column("counts_").to_pylist()]).astype(np.int64)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.r_[first, len(key)]))
        out, at = [], 0
        for block, k in zip(blocks, keys, strict=True):
            part = total[at : at + len(k)]
            at += len(k)
            if part.max() > 1:
                out.append((block, bucket, 0, np.packbits(part > 1).tobytes(), np.packbits(part > hot).tobytes()))
        return _rows(out, ANSWER)

    return run


def _masks(block: Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For the block's distinct anchors: repeated, hot."""
    keys, _ = block.anchors()
    repeated, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    place = {b: (a, e) for b, a, e in _slices(_bucket(keys, buckets))}
    for row in answers.to_pylist():
        if row["kind_"] == 0:
            a, e = place[row["bucket_"]]
            repeated[a:e] = np.unpackbits(np.frombuffer(row["a_"], np.uint8), count=e - a)
            hot[a:e] = np.unpackbits(np.frombuffer(row["b_"], np.uint8), count=e - a)
    return repeated, hot


def _cut(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows([], FRAGMENTS)
        number = docs.column("block_")[0].as_py()
        block = Block(docs)
        _, _, (key, size, least, begin) = block.fragments(*_masks(block, answers, buckets))
        width = size + LENGTH - 1
        part = _bucket(key, buckets * PARTS)
        rows = []
        for b, a, e in _slices(part // PARTS):
            counts = np.bincount(part[a:e] - b * PARTS, minlength=PARTS).astype(np.uint32)
            rows.append((number, b, counts.tobytes(), key[a:e].astype(np.uint32).tobytes(), size[a:e].astype(np.uint8).tobytes(), least[a:e].tobytes(), _pick(block.text, begin[a:e], width[a:e])))
        return _rows(rows, FRAGMENTS)

    return run


def _pick(text: np.ndarray, begin: np.ndarray, width: np.ndarray) -> bytes:
    """The bytes of pieces, one after the other."""
    shift = begin - (np.cumsum(width) - width)
    return text[np.arange(int(width.sum())) + np.repeat(shift, width)].tobytes()


def earliest(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Smallest document of each 50-byte string, over all strings of all fragments in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(bytes([SEPARATOR]).join(texts), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    number = np.full(len(joined), -1, np.int64)
    number[start] = np.arange(len(start))
    view = words(joined)
    # The ends of fragments begin no string: most suffixes need no place.
    order = suffix_order(joined, view, number >= 0)
    first = np.flatnonzero(common_prefixes(order, view) < LENGTH)
    ranked = number[order]
    least = np.minimum.reduceat(docs[owner[ranked]], first)
    out = np.empty(len(start), np.int64)
    out[ranked] = np.repeat(least, np.diff(np.r_[first, len(order)]))
    return out


def _suffixes(rows: pa.Table) -> pa.Table:
    """Parts of the bucket one after the other: strings of different parts have different anchors."""
    bucket = rows.column("bucket_")[0].as_py()
    blocks = rows.column("block_").to_pylist()
    sent = [_Sent(*row) for row in zip(*(rows.column(c) for c in ("parts_", "keys_", "sizes_", "docs_", "bytes_")), strict=True)]
    answers: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in sent]
    for part in range(PARTS):
        cuts = [block.fragments(part) for block in sent]
        key, size, doc, raw = (np.concatenate(x) for x in zip(*cuts, strict=True))
        if not len(key):
            continue
        which, (first, values, lengths) = _least_by_fragment(key, size, doc, raw)
        at = 0
        for answer, (own, *_) in zip(answers, cuts, strict=True):
            chosen = which[at : at + len(own)]
            at += len(own)
            runs = _expanded(first[chosen], first[chosen + 1] - first[chosen])
            answer.append((values[runs], lengths[runs]))
    out = []
    for block, answer in zip(blocks, answers, strict=True):
        values, lengths = (np.concatenate(x) for x in zip(*answer, strict=True))
        out.append((block, bucket, 1, values.tobytes(), lengths.astype(np.uint8).tobytes()))
    return _rows(out, ANSWER)


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, as many as its count."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def _least_by_fragment(
    key: np.ndarray, size: np.ndarray, doc: np.ndarray, raw: np.ndarray
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct fragment of each one sent; and of the distinct ones runs of (smallest document, strings).

    ``key`` holds some bits of the anchor: two anchors that agree in them are sorted together.
    """
    width = size + LENGTH - 1
    begin = np.cumsum(width) - width
    view = words(raw)
    mark = key.astype(np.uint64) << np.uint64(32) | _marks(view, begin, size) >> np.uint64(32)
    order = np.argsort(mark)
    mark, begin, size = mark[order], begin[order], size[order]
    same = np.r_[False, mark[1:] == mark[:-1]]
    doubt = np.flatnonzero(same)
    if _equal(view, begin[doubt], size[doubt], begin[doubt - 1], size[doubt - 1]).all():
        number = np.cumsum(~same) - 1
    else:
        number = _numbered(raw, begin, size, key[order])
    which = np.empty(len(key), np.int64)
    which[order] = number
    one = np.unique(number, return_index=True)[1]
    least = np.full(len(one), LAST, np.int64)
    np.minimum.at(least, which, doc)
    anchor, begin, size = mark[one] >> np.uint64(32), begin[one], size[one]
    lone = np.ones(len(one), bool)
    lone[1:] &= anchor[1:] != anchor[:-1]
    lone[:-1] &= anchor[1:] != anchor[:-1]
    if lone.all():
        return which, (np.arange(len(one) + 1), least, size)
    met = np.flatnonzero(~lone)
    text = raw.tobytes()
    found = earliest([text[a : a + n + LENGTH - 1] for a, n in zip(begin[met].tolist(), size[met].tolist())], least[met])
    new = np.r_[True, found[1:] != found[:-1]]
    starts = np.cumsum(size[met]) - size[met]
    new[starts] = True
    at = np.flatnonzero(new)
    runs = np.ones(len(one), np.int64)
    runs[met] = np.add.reduceat(new, starts, dtype=np.int64)
    first = np.r_[0, np.cumsum(runs)]
    values, lengths = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    values[first[:-1][lone]], lengths[first[:-1][lone]] = least[lone], size[lone]
    place = _expanded(first[met], runs[met])
    values[place], lengths[place] = found[at], np.diff(np.r_[at, len(found)])
    return which, (first, values, lengths)


class _Sent:
    """What one block sent to a bucket."""

    def __init__(self, parts: pa.Scalar, keys: pa.Scalar, sizes: pa.Scalar, docs: pa.Scalar, raw: pa.Scalar):
        def numbers(value: pa.Scalar, kind: type) -> np.ndarray:
            return np.frombuffer(value.as_buffer(), kind)

        self.size = numbers(sizes, np.uint8).astype(np.int64)
        self.ends = np.r_[0, np.cumsum(self.size + LENGTH - 1)]
        self.keys, self.docs, self.raw = numbers(keys, np.uint32), numbers(docs, np.int64), numbers(raw, np.uint8)
        self.part = np.r_[0, np.cumsum(numbers(parts, np.uint32))]

    def fragments(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the anchors, numbers of strings, documents, and the bytes in a row."""
        a, e = self.part[part], self.part[part + 1]
        return self.keys[a:e], self.size[a:e], self.docs[a:e], self.raw[self.ends[a] : self.ends[e]]


def _remove(buckets: int, names: list[str], schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = Block(docs)
        (begin, size, doc), which, (key, width, _, _) = block.fragments(*_masks(block, answers, buckets))
        told = {row["bucket_"]: (row["a_"], row["b_"]) for row in answers.to_pylist() if row["kind_"] == 1}
        got = [told[b] for b, _, _ in _slices(_bucket(key, buckets))]
        least = np.frombuffer(b"".join(a for a, _ in got), np.int64)
        ends = np.cumsum(np.frombuffer(b"".join(b for _, b in got), np.uint8), dtype=np.int64)
        starts = np.r_[0, ends]
        # Every fragment begins with a run of its own.
        base = np.cumsum(width) - width
        first = np.r_[np.searchsorted(starts, base), len(ends)]
        count = np.diff(first)[which]
        run, piece = _expanded(first[which], count), np.repeat(np.arange(len(begin)), count)
        hit = least[run] < doc[piece]
        run, piece = run[hit], piece[hit]
        shift = begin[piece] - base[which[piece]]
        # A byte goes if one of the 50 strings that cover it goes. No two runs begin or end in one place.
        total = len(block.text)
        change = np.zeros(total + 1, np.int32)
        change[starts[run] + shift] += 1
        change[ends[run] + shift + LENGTH - 1] -= 1
        gone = np.cumsum(change[:total], dtype=np.int32) > 0
        raw = block.text.tobytes()
        results = [None] * docs.num_rows
        sums, texts = "kept_sha256" in names, "text_" in names
        for k, row in enumerate(block.order.tolist()):
            low, high = int(block.ends[k] - block.lengths[k]), int(block.ends[k])
            mask = gone[low:high]
            if mask.any():
                kept = block.text[low:high][~mask].tobytes()
                removed = int(mask.sum())
                count = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            else:
                kept, removed, count = raw[low:high], 0, 0
            results[row] = (
                high - low, removed, count, hashlib.sha256(kept).hexdigest() if sums else None, kept,
                kept.decode("utf-8", "ignore") if texts else None,
            )
        columns = [docs.column("row_")]
        for name in names:
            columns.append(pa.array([r[RESULTS.index(name)] for r in results], schema.field(name).type))
        return pa.table(dict(zip(schema.names, columns, strict=True)))

    return run


def remove_repeats(docs: DataFrame, carried: list[str], results: list[str], hot: int = HOT) -> DataFrame:
    """The ``carried`` columns of ``docs`` in a struct ``row_``, and the ``results`` for each row.

    Results: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    kept_ (the bytes that stay), text_ (the same as text, without halves of
    characters at a cut).
    """
    least = least_parts(docs.sparkSession)
    size = total_bytes(docs)
    blocks = parts_for(size, BLOCK_BYTES, least)
    buckets = parts_for(size // 18, BUCKET_ANCHORS, least)
    dealt = docs.select(
        F.struct(*[docs[c] for c in carried]).alias("row_"),
        docs["doc_id"].cast("long").alias("id_"),
        docs["text"].cast("string").alias("text_"),
        F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(blocks)).cast("long").alias("block_"),
    ).repartition(blocks, "block_")
    # As many partitions as buckets, so that a task's share does not grow with the input.
    sketches = dealt.groupBy("block_").applyInArrow(_sketch(buckets), SKETCH).repartition(buckets, "bucket_")
    masks = sketches.groupBy("bucket_").applyInArrow(_count(hot), ANSWER)
    fragments = dealt.groupBy("block_").cogroup(masks.groupBy("block_")).applyInArrow(_cut(buckets), FRAGMENTS)
    found = fragments.repartition(buckets, "bucket_").groupBy("bucket_").applyInArrow(_suffixes, ANSWER)
    schema = T.StructType([dealt.schema["row_"], *(T.StructField(r, KINDS[r]) for r in results)])
    answers = masks.unionByName(found)
    run = _remove(buckets, results, to_arrow_schema(schema))
    return dealt.groupBy("block_").cogroup(answers.groupBy("block_")).applyInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return remove_repeats(docs, ["doc_id"], names).select("row_.doc_id", *names)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept bytes as text; halves of characters at a cut are left out.

    All rows and columns stay, and ``n_chars`` follows the text where it is present.
    """
    others = [c for c in docs.columns if c != "text"]
    # The same task removes and decodes: a second one behind it would hold another Python worker.
    kept = remove_repeats(docs, others, ["text_"])
    out = kept.select("row_.*", F.col("text_").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT r, doc_id, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS p, x FROM d),
strings AS (SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM windows),
firsts AS (SELECT s, min(doc_id) AS earliest FROM strings GROUP BY s),
hits AS (SELECT r, p FROM strings JOIN firsts USING (s) WHERE earliest < doc_id),
runs AS (
  SELECT r, min(p) AS a, max(p) + 50 AS b FROM (
    SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM (
      SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hits))
  GROUP BY r, run),
gaps AS (
  SELECT r, b AS low, lead(a) OVER (PARTITION BY r ORDER BY a) AS high FROM (
    SELECT r, a, b FROM runs UNION ALL SELECT r, -1, 0 FROM d)),
kept AS (
  SELECT r, string_agg(substr(x, 2 * low + 1, 2 * (coalesce(high, len(x) // 2) - low)), '' ORDER BY low) AS k
  FROM gaps JOIN d USING (r) GROUP BY r),
totals AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN totals USING (r)
"""
