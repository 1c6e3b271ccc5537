"""Which tokens of one tokenizer stand for which tokens of another.

Both tokenizers encode the same bytes: a space and the text. Offsets where a
token of A and a token of B end together cut the tokens into groups; each token
of A in a group is linked with each of B there. Over the corpus, the documents
that hold a pair of ids linked are counted.

1. Short documents are aligned where they lie.
2. Long ones are cut into pieces at single spaces between words, where both
   tokenizers always begin a token, so a piece has the tokens it would have in
   the whole. Pieces are spread over all tasks, whatever document they are from.
3. The tokens of a piece are cut by fixed byte ranges into fragments. A fragment
   has an open prefix (up to its first common end), closed groups, and an open
   suffix; without a common end it is open as a whole. Fragments form a monoid:
   two neighbours make a fragment again, and a suffix and the next prefix close
   to a group. A tree of reductions over (document, position) composes them;
   only open ends travel, closed groups stay where they are. At last all groups
   of a document pass one task in order, as a stream, for its checksum.
4. Each block of documents hands over its distinct pairs once, with the number
   of documents that hold them. Counts are added up by pair, the highest of each
   id of A is found (as many rows as A has ids), and every block gets the counts
   of its own pairs back.

Texts that are null, empty, or not given back byte by byte by both tokenizers
have no tokens: zeros and an empty checksum. Strings of special tokens inside a
text are plain text. Rows with equal ids or texts count as documents of their
own; each input row gives one result row. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.llm.common import batches, least_parts, parts_for, total_bytes
from gaugewatch.llm.tokens import default_file, encoder
from gaugewatch.session import fresh_path

LONG = 32 << 10  # bytes; longer documents go through fragments
PIECE = 32 << 10  # characters of a piece, at least
RANGE = 4 << 10  # bytes of a fragment
FAN = 16
BLOCK = 4 << 20  # bytes of text whose pairs are handed over together
MANY = 4096  # links of a group beyond which its ids are counted first
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")

ROWS = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes binary, weights binary"
)
PIECES = "row long, doc_id long, pos long, text string"
FRAGMENTS = (
    "row long, doc_id long, pos long, good boolean, n_a long, n_b long, a binary, b binary, "
    "closed boolean, pre_a binary, pre_b binary, suf_a binary, suf_b binary"
)
EDGES = "joint boolean, row long, pos long, closed boolean, pre_a binary, pre_b binary, suf_a binary, suf_b binary"
STREAM = "row long, pos long, turn int, doc_id long, good boolean, n_a long, n_b long, a binary, b binary"
COUNTS = "block long, code long, docs long"


class Pair:
    """Both tokenizers of a task, with the bytes of their tokens and ready-made texts of their ids."""

    def __init__(self, path: str, pattern: str, model: str):
        self.a = encoder(path, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a = self.a.lengths
        self.len_b = np.array([len(r) for r in self.raw_b], np.int64)
        self.n_b = len(pieces)
        self.kind = _kind(len(self.len_a), self.n_b)
        # Decimal digits of all ids, and a place behind them for a separator.
        spelled = [str(i).encode() for i in range(max(len(self.len_a), self.n_b))]
        self.n_digits = np.array([len(x) for x in spelled], np.int64)
        wide = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(wide) for x in spelled), np.uint8).reshape(-1, wide)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Ids of a space and the text, and the number of bytes; None if one of the two changes the text."""
        raw = b" " + text.encode()
        a, b = np.array(self.a.plain(" " + text), np.int64), self.b.encode(text)
        # Tokens of A are cut from the bytes one after the other, so they are whole if none is missing; B may change texts.
        if int(self.len_a[a].sum()) != len(raw) or b"".join(map(self.raw_b.__getitem__, b)) != raw:
            return None
        return a, np.array(b, np.int64), len(raw)


@functools.cache
def tokenizers(path: str, pattern: str, model: str) -> Pair:
    return Pair(path, pattern, model)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return (*default_file(), public_tokenizers.path("piece_bpe_32k.model"))


class Groups(NamedTuple):
    """Closed groups: how many, their links, their text, and their pairs of ids with the links of each."""

    count: int
    links: int
    text: bytes
    codes: np.ndarray
    weights: np.ndarray


NONE = Groups(0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their weights added up."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(weights, first)


def _links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, count: int, both: Pair):
    """(pair of ids, links, group) of every link; the ids of large groups are counted before they are paired."""
    size_a, size_b = np.bincount(of_a, minlength=count), np.bincount(of_b, minlength=count)
    start_b = np.cumsum(size_b) - size_b
    links = size_a * size_b
    small = np.flatnonzero((links <= MANY)[of_a])
    times = size_b[of_a[small]]
    left = np.repeat(small, times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + start_b[of_a[left]]
    codes, weights, group = [a[left] * both.n_b + b[right]], [np.ones(len(left), np.int64)], [of_a[left]]
    for g in np.flatnonzero(links > MANY).tolist():
        own_a, n_a = np.unique(a[of_a == g], return_counts=True)
        own_b, n_b = np.unique(b[of_b == g], return_counts=True)
        codes.append((own_a[:, None] * both.n_b + own_b[None, :]).ravel())
        weights.append((n_a[:, None] * n_b[None, :]).ravel())
        group.append(np.full(len(codes[-1]), g))
    return np.concatenate(codes), np.concatenate(weights), np.concatenate(group)


def _spelled(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, count: int, both: Pair) -> tuple[bytes, np.ndarray]:
    """The groups as text, the tokens of A, then those of B in each; and where each token's text ends."""
    size_a, size_b = np.bincount(of_a, minlength=count), np.bincount(of_b, minlength=count)
    last_a, last_b = np.r_[of_a[1:] != of_a[:-1], True], np.r_[of_b[1:] != of_b[:-1], True]
    ids, behind = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    at_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[of_a]
    at_b = np.arange(len(b)) + np.cumsum(size_a)[of_b]
    ids[at_a], behind[at_a] = a, np.where(last_a, ord("|"), ord(","))
    ids[at_b], behind[at_b] = b, np.where(last_b, ord(";"), ord(","))
    rows, size = both.digits[ids], both.n_digits[ids]
    rows[np.arange(len(ids)), size] = behind
    return rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes(), np.cumsum(size + 1)


def groups_of(docs: list[tuple[np.ndarray, np.ndarray]], both: Pair) -> list[Groups]:
    """Groups of several stretches at once; in each, the tokens of both have the same bytes."""
    if not docs:
        return []
    a, b = np.concatenate([x for x, _ in docs]), np.concatenate([y for _, y in docs])
    if not len(a) or not len(b):
        return [NONE] * len(docs)
    # Laid one after the other, all stretches end together, so no group meets two.
    end_a, end_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
    ends = np.zeros((2, int(end_a[-1]) + 1), bool)
    ends[0, end_a] = ends[1, end_b] = True
    hit_a, hit_b = ends[1, end_a], ends[0, end_b]
    of_a, of_b, count = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b, int(hit_a.sum())
    doc = np.repeat(np.arange(len(docs)), [len(x) for x, _ in docs])[hit_a]
    codes, weights, group = _links(a, b, of_a, of_b, count, both)
    span = len(both.len_a) * both.n_b
    key, weights = merged(doc[group] * span + codes, weights)
    cuts = np.searchsorted(key, np.arange(len(docs) + 1) * span).tolist()
    links = np.add.reduceat(np.r_[weights, 0], cuts[:-1]) * (np.diff(cuts) > 0)
    counts = np.bincount(doc, minlength=len(docs)).tolist()
    spelled, until = _spelled(a, b, of_a, of_b, count, both)
    tokens = np.cumsum([0, *(len(x) + len(y) for x, y in docs)])
    until = np.r_[0, until][tokens].tolist()
    out = []
    for k, (low, high) in enumerate(zip(until[:-1], until[1:], strict=True)):
        own = slice(cuts[k], cuts[k + 1])
        text = spelled[low : high - 1] if high > low else b""
        out.append(Groups(counts[k], int(links[k]), text, key[own] - k * span, weights[own]))
    return out


def whole(a: np.ndarray, b: np.ndarray, both: Pair) -> Groups:
    return groups_of([(a, b)], both)[0]


class Fragment(NamedTuple):
    """Open prefix, closed groups (kept elsewhere), open suffix; not ``closed``: the prefix is all there is."""

    closed: bool
    pre_a: np.ndarray
    pre_b: np.ndarray
    suf_a: np.ndarray
    suf_b: np.ndarray


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[np.ndarray, np.ndarray] | None]:
    """The fragment of two neighbours, and the group that closes between them, if any. Associative."""
    join = np.concatenate
    if not left.closed:
        return right._replace(pre_a=join([left.pre_a, right.pre_a]), pre_b=join([left.pre_b, right.pre_b])), None
    middle = join([left.suf_a, right.pre_a]), join([left.suf_b, right.pre_b])
    if not right.closed:
        return left._replace(suf_a=middle[0], suf_b=middle[1]), None
    return left._replace(suf_a=right.suf_a, suf_b=right.suf_b), middle


def fragment(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """The fragment of some neighbouring tokens of both, whose ends are given; and the tokens of its closed groups."""
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    empty = np.zeros(0, np.int64)
    if not len(common):
        return Fragment(False, a, b, empty, empty), empty, empty
    (first_a, last_a), (first_b, last_b) = (np.searchsorted(end, common[[0, -1]], "right") for end in (end_a, end_b))
    edge = Fragment(True, a[:first_a], b[:first_b], a[last_a:], b[last_b:])
    return edge, a[first_a:last_a], b[first_b:last_b]


def _ids(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def _kind(n_a: int, n_b: int) -> str:
    """How a pair of ids is kept: in four bytes if all pairs of the two vocabularies fit."""
    return "<u4" if n_a * n_b < 2**32 else "<u8"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(names, columns, strict=True)], [n for n, _ in names])


class _Blocks:
    """Result rows of documents, and one row of pairs for each block of them."""

    def __init__(self, low: int, kind: str):
        self.kind = kind
        # Tasks of the two paths have numbers of their own.
        self.number = ((2 * TaskContext.get().partitionId() + low) << 32) - 1
        self._begin()

    def _begin(self) -> None:
        self.number += 1
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, n_a: int, n_b: int, groups: Groups, digest: str, size: int) -> None:
        self.pairs.append(groups.codes)
        self.rows.append((
            0, self.number, doc_id, n_a, n_b, groups.count, groups.links, digest,
            groups.codes.astype(self.kind).tobytes(), _ids(groups.weights),
        ))
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            codes, docs = np.unique(np.concatenate(self.pairs), return_counts=True)
            self.rows.append((1, self.number, None, None, None, None, None, None, codes.astype(self.kind).tobytes(), _ids(docs)))
            yield _batch(self.rows, ROWS)
            self._begin()


def _short(files: tuple[str, str, str], block: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        out = _Blocks(0, both.kind)
        for batch in batches(source, 1 << 20):
            ids = [both.encode(text) if text else None for text in batch.column(1).to_pylist()]
            found = iter(groups_of([(i[0], i[1]) for i in ids if i is not None], both))
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                if own is None:
                    out.add(doc_id, 0, 0, NONE, "", 1)
                else:
                    a, b, size = own
                    groups = next(found)
                    out.add(doc_id, len(a), len(b), groups, hashlib.sha256(groups.text).hexdigest(), size)
                if out.size >= block:
                    yield from out.flush()
        yield from out.flush()

    return run


def pieces_of(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(first byte in the space and the text, piece); each piece stands for itself with a space before it."""
    at, low = 0, 0
    while True:
        found = CUT.search(text, low + size)
        piece = text[low : found.start()] if found else text[low:]
        yield at, piece
        if not found:
            return
        at += 1 + len(piece.encode())
        low = found.end()


def _cut(size: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches(source, 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # A document's pieces go out in batches, so that none holds a whole long text again.
                rows, held = [], 0
                for at, piece in pieces_of(text, size):
                    rows.append((number, doc_id, at, piece))
                    held += len(piece)
                    if held > 4 << 20:
                        yield _batch(rows, PIECES)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, PIECES)
                number += 1

    return run


def _fragments(files: tuple[str, str, str], width: int):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        for batch in batches(source, 1 << 20):
            rows = []
            for piece in batch.to_pylist():
                ids = both.encode(piece["text"])
                begin = piece["pos"]
                if ids is None:
                    rows.append((piece["row"], piece["doc_id"], begin, False, 0, 0, b"", b"", False, b"", b"", b"", b""))
                    continue
                a, b, size = ids
                end_a, end_b = begin + np.cumsum(both.len_a[a]), begin + np.cumsum(both.len_b[b])
                # A token belongs to the range of its last byte.
                for r in range(begin // width, (begin + size - 1) // width + 1):
                    cut_a, cut_b = (np.searchsorted(e, [r * width, (r + 1) * width], "right") for e in (end_a, end_b))
                    in_a, in_b = slice(*cut_a.tolist()), slice(*cut_b.tolist())
                    edge, inner_a, inner_b = fragment(a[in_a], end_a[in_a], b[in_b], end_b[in_b])
                    rows.append((
                        piece["row"], piece["doc_id"], max(begin, r * width), True, in_a.stop - in_a.start, in_b.stop - in_b.start,
                        _ids(inner_a), _ids(inner_b), edge.closed, *(_ids(x) for x in edge[1:]),
                    ))
            if rows:
                yield _batch(rows, FRAGMENTS)

    return run


def _compose(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of one document to one fragment, and the groups that close between them."""
    out, whole_ = [], None
    rows = table.sort_by("pos").to_pylist()
    for row in rows:
        edge = Fragment(row["closed"], *(_numbers(row[c]) for c in Fragment._fields[1:]))
        if whole_ is None:
            whole_ = edge
            continue
        whole_, group = compose(whole_, edge)
        if group is not None:
            # It stands before the closed groups of the fragment at this place.
            out.append((True, row["row"], row["pos"], True, *(_ids(x) for x in group), b"", b""))
    out.append((False, rows[0]["row"], rows[0]["pos"], whole_.closed, *(_ids(x) for x in whole_[1:])))
    return pa.Table.from_batches([_batch(out, EDGES)])


def _stream(files: tuple[str, str, str], block: int):
    """Fragments and joints of whole documents in order: counts and checksum of each document."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        out = _Blocks(1, both.kind)
        row = doc_id = good = digest = None
        n_a = n_b = count = links = size = held = 0
        codes, weights = [], []

        def done() -> None:
            if row is None:
                return
            if good:
                groups = Groups(count, links, b"", *merged(np.concatenate(codes), np.concatenate(weights)))
                out.add(doc_id, n_a, n_b, groups, digest.hexdigest(), size)
            else:
                out.add(doc_id, 0, 0, NONE, "", 1)

        parts = (part for batch in source for low in range(0, batch.num_rows, 256) for part in batch.slice(low, 256).to_pylist())
        for part in parts:
            if part["row"] != row:
                done()
                if out.size >= block:
                    yield from out.flush()
                row, doc_id, good = part["row"], None, True
                n_a = n_b = count = links = size = held = 0
                codes, weights, digest = [NONE.codes], [NONE.weights], hashlib.sha256()
            if part["turn"] == 1:
                doc_id, good = part["doc_id"], good and part["good"]
                n_a, n_b = n_a + part["n_a"], n_b + part["n_b"]
            group = whole(_numbers(part["a"]), _numbers(part["b"]), both)
            if not group.count:
                continue
            if count:
                digest.update(b";")
            digest.update(group.text)
            count, links, size = count + group.count, links + group.links, size + len(group.text)
            codes.append(group.codes)
            weights.append(group.weights)
            held += len(group.codes)
            if held > 1 << 20:  # distinct pairs stay, however long the document
                kept = merged(np.concatenate(codes), np.concatenate(weights))
                codes, weights, held = [kept[0]], [kept[1]], 0
        done()
        yield from out.flush()

    return run


def _long(docs: DataFrame, files: tuple[str, str, str], at: str, piece: int, width: int, fan: int, block: int) -> DataFrame:
    """ROWS of long documents, by fragments."""
    spark = docs.sparkSession
    docs.mapInArrow(_cut(piece), PIECES).repartition("row", "pos").write.parquet(f"{at}/pieces")
    spark.read.schema(PIECES).parquet(f"{at}/pieces").mapInArrow(_fragments(files, width), FRAGMENTS).write.parquet(f"{at}/fragments")
    fragments = spark.read.schema(FRAGMENTS).parquet(f"{at}/fragments")
    last = fragments.agg(F.max("pos")).first()[0]
    joints = None
    edges = fragments.select(F.lit(False).alias("joint"), *[c.split()[0] for c in EDGES.split(", ")[1:]])
    level, span = 0, width
    while last is not None and (level == 0 or span <= last):
        level, span = level + 1, span * fan
        near = edges.withColumn("near", F.floor(F.col("pos") / F.lit(span)))
        near.groupBy("row", "near").applyInArrow(_compose_grouped, EDGES).write.parquet(f"{at}/level-{level}")
        both = spark.read.schema(EDGES).parquet(f"{at}/level-{level}")
        edges, closed = both.where(~F.col("joint")), both.where("joint")
        joints = closed if joints is None else joints.unionByName(closed)
    # What is left is one fragment per document: its prefix is the first group.
    first = edges.withColumn("pos", F.lit(-1).cast("long"))
    joints = first if joints is None else joints.unionByName(first)
    null = {n: F.lit(None).cast(k).alias(n) for n, k in (c.split() for c in STREAM.split(", "))}
    names = list(null)
    turns = joints.select(*[
        {"row": F.col("row"), "pos": F.col("pos"), "turn": F.lit(0).alias("turn"), "a": F.col("pre_a").alias("a"), "b": F.col("pre_b").alias("b")}
        .get(n, null[n]) for n in names
    ])
    own = fragments.withColumn("turn", F.lit(1)).select(*names)
    ordered = own.unionByName(turns).repartition("row").sortWithinPartitions("row", "pos", "turn")
    return ordered.mapInArrow(_stream(files, block), ROWS)


def _compose_grouped(table: pa.Table) -> pa.Table:
    return _compose(table.drop_columns(["near"]))


def _explode(kind: str):
    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], kind).astype(np.int64)
                if len(codes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(codes), row["block"])), pa.array(codes), pa.array(_numbers(row["weights"]))],
                        ["block", "code", "docs"],
                    )

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answer(kind: str):
    """A block's documents with the corpus's counts of their pairs."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        code = counts.column("code").to_numpy()
        code, at = np.unique(code, return_index=True)
        total, best = counts.column("total").to_numpy()[at], counts.column("best").to_numpy(zero_copy_only=False)[at].astype(bool)
        n_best, sums = [], []
        for codes, weights in zip(docs.column("codes").to_pylist(), docs.column("weights").to_pylist(), strict=True):
            place, weight = np.searchsorted(code, np.frombuffer(codes, kind).astype(np.int64)), _numbers(weights)
            n_best.append(int(weight[best[place]].sum()))
            sums.append(int((weight * total[place]).sum()))
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return pa.table({
            **{c: out.column(c) for c in out.column_names}, "n_best": pa.array(n_best, pa.int64()),
            "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs.column("groups_sha256"),
        })

    return run


class Alignment(NamedTuple):
    """``documents``: a row of counts per document; ``pairs``: a_id, b_id, docs (how many hold it) and best."""

    documents: DataFrame
    pairs: DataFrame


def align(
    docs: DataFrame, files: tuple[str, str, str] | None = None, long: int = LONG, piece: int = PIECE, width: int = RANGE,
    fan: int = FAN, block: int = BLOCK,
) -> Alignment:
    """Links of all documents; ``files``: path and pattern of A, path of B."""
    spark = docs.sparkSession
    files = files or default_files()
    both = tokenizers(*files)
    n_b, kind = both.n_b, both.kind
    at = fresh_path(spark, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows.where(size <= long).mapInArrow(_short(files, block), ROWS).write.parquet(f"{at}/aligned/path=short")
    _long(rows.where(size > long), files, at, piece, width, fan, block).write.parquet(f"{at}/aligned/path=long")
    aligned = spark.read.schema(ROWS).parquet(f"{at}/aligned/path=short", f"{at}/aligned/path=long")

    held = aligned.where("kind = 1").select("block", "codes", "weights").mapInArrow(_explode(kind), COUNTS)
    held.groupBy("code").agg(F.sum("docs").alias("total")).write.parquet(f"{at}/totals")
    totals = spark.read.schema("code long, total long").parquet(f"{at}/totals").withColumn("a_id", F.expr(f"code div {n_b}"))
    # One row per id of A: the size of its vocabulary is the bound.
    highest = totals.groupBy("a_id").agg(F.max("total").alias("highest"))
    known = totals.join(F.broadcast(highest), "a_id").select("code", "a_id", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = held.select("block", "code").join(known.select("code", "total", "best"), "code")
    texts = aligned.where("kind = 0").drop("kind")
    # A task's share of both sides does not grow with the input.
    parts = parts_for(total_bytes(docs), 4 * block, least_parts(spark))
    texts, answers = texts.repartition(parts, "block"), answers.repartition(parts, "block")
    result = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer(kind), RESULT)
    pairs = known.select("a_id", (F.col("code") % n_b).alias("b_id"), F.col("total").alias("docs"), "best")
    return Alignment(result, pairs)


def groups(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, start, end (bytes of the text), a_ids, b_ids of every group, in place; for texts that one task can hold."""
    files = files or default_files()

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        for batch in batches(source, 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = both.encode(text) if text else None
                if ids is None:
                    continue
                a, b, _ = ids
                end_a, end_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
                common = np.intersect1d(end_a, end_b, assume_unique=True)
                lists = [
                    pa.ListArray.from_arrays(np.r_[0, np.searchsorted(end, common) + 1].astype(np.int32), pa.array(x))
                    for x, end in ((a, end_a), (b, end_b))
                ]
                # The space before the text is no part of it.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * len(common), pa.int64()), pa.array(np.maximum(np.r_[0, common[:-1]] - 1, 0)),
                        pa.array(common - 1), *lists,
                    ],
                    ["doc_id", "start", "end", "a_ids", "b_ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, a_ids array<long>, b_ids array<long>")


def digest(docs: DataFrame) -> DataFrame:
    return align(docs).documents
