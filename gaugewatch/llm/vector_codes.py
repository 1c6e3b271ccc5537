"""Vectors compressed to codes: product quantisation by Lloyd's rounds over cover trees.

Vectors become integers, ``floor(1024 x)``, and are cut into equal consecutive
parts; each part position has a codebook. One round assigns every part to the
nearest entry and moves each entry to the floored mean of its parts.

1. Each task cuts its rows into blocks of bounded size and builds one cover
   tree per block and part position: a node holds a centre, the distance of
   its farthest point and the range of its points, which lie together, so the
   sum over any subtree is a difference of cumulative sums. Trees are written
   once and serve all rounds.
2. In a round, a node at distance d1 from its nearest entry and d2 from the
   next, with all points within r of the centre, goes whole to that entry if
   ``d2 - d1 > 2 r``: by the triangle inequality no point in it has another
   nearest entry. Only other nodes descend; at ambiguous leaves the points are
   compared exactly, in integers, ties to the lower index.
3. Counts and sums per entry are added up in Spark. The driver holds codebooks
   only: their size does not depend on the rows.

All results are exact and do not depend on how rows lie in files. Rows whose
vector is null, empty, or holds null or non-finite components take no part, nor
do vectors whose length differs from the most common one (the smaller of
equally common ones). That length must be a multiple of the number of parts.
Codebooks start from the smallest ids, rows with equal ids by their vectors,
null ids last; with fewer rows than entries, codebooks have as many entries as
rows. Repeated rows count as often as they occur. Components beyond 2^27 (a
value of 131,072) raise an error, as their squared distances leave 64 bits. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.operators.scale import dimension_join
from gaugewatch.session import fresh_path

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
LEAF = 32
FAN = 16
BASE = 2.0
LARGEST = 1 << 27
EXACT = 2**53
NODE = np.dtype([("centre", "<i4"), ("begin", "<i4"), ("end", "<i4"), ("first", "<i4"), ("count", "<i4"), ("radius", "<f8")])
BLOCKS = "block long, ids binary, no_id binary, labels array<string>, points array<binary>, places array<binary>, nodes array<binary>"


def usable(vectors: DataFrame, label: str | None) -> DataFrame:
    """(vec_id, label, e) of the rows that can take part, of any length."""
    named = F.lit(None) if label is None else vectors[label]
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), named.cast("string").alias("label"),
        vectors["embedding"].cast("array<double>").alias("e"),
    )
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & good)


def integers(rows: np.ndarray) -> np.ndarray:
    values = np.floor(SCALE * rows)
    if values.size and np.abs(values).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} leave the range of exact distances")
    return values.astype(np.int64)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances: by a product of floats while all its values are whole ones."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * points.shape[1] < EXACT:
        p, c = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)
    out = np.empty((len(points), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        out[:, k] = ((points - entry) ** 2).sum(1)
    return out


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and nodes of a cover tree over them.

    The children of a node are centres taken farthest first, its own centre
    being the first, until all points are within 1 / BASE of its radius or there
    are FAN of them. So centres are as far apart as the radius they cover; each
    point goes to its nearest centre. Nodes of few points, or of equal ones, are leaves.
    """
    order = np.arange(len(points))
    near = points.astype(np.float64)

    def distance(rows: np.ndarray, centre: int) -> np.ndarray:
        gap = near[rows] - near[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    nodes = [(0, 0, len(points), 0, 0, float(distance(order, 0).max()))]
    at = 0
    while at < len(nodes):
        centre, begin, end, _, _, radius = nodes[at]
        if end - begin > LEAF and radius > 0:
            rows = order[begin:end]
            least, owner = distance(rows, centre), np.zeros(end - begin, np.int64)
            centres = [centre]
            while len(centres) < FAN and least.max() > radius / BASE:
                centres.append(int(rows[least.argmax()]))
                other = distance(rows, centres[-1])
                nearer = other < least
                owner[nearer] = len(centres) - 1
                least = np.where(nearer, other, least)
            sorted_ = np.argsort(owner, kind="stable")
            order[begin:end] = rows[sorted_]
            least = least[sorted_]
            ends = begin + np.cumsum(np.bincount(owner, minlength=len(centres)))
            nodes[at] = (centre, begin, end, len(nodes), len(centres), radius)
            low = begin
            for c, high in zip(centres, ends.tolist(), strict=True):
                nodes.append((c, low, high, 0, 0, float(least[low - begin : high - begin].max())))
                low = high
        at += 1
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    out = np.array(nodes, NODE)
    out["centre"] = place[out["centre"]]
    return order, out


def settle(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, entry) of the subtrees that go whole; and (point, entry) of those compared exactly."""
    begin, end, entry, single = [], [], [], []
    open_ = np.zeros(1, np.int64)
    while len(open_):
        own = nodes[open_]
        square = squares(points[own["centre"]], entries)
        best = square.argmin(1)
        distance = np.sqrt(square.astype(np.float64))
        if len(entries) > 1:
            two = np.partition(distance, 1, axis=1)[:, :2]
            # The slack covers the rounding of roots and radii.
            sure = (two[:, 1] - two[:, 0]) * (1 - 1e-9) > 2 * own["radius"] * (1 + 1e-9) + 1e-6
        else:
            sure = np.ones(len(own), bool)
        sure |= own["radius"] == 0
        begin.append(own["begin"][sure])
        end.append(own["end"][sure])
        entry.append(best[sure])
        rest = own[~sure]
        leaf = rest["count"] == 0
        single += [np.arange(a, b) for a, b in zip(rest["begin"][leaf], rest["end"][leaf], strict=True)]
        inner = rest[~leaf]
        open_ = np.repeat(inner["first"], inner["count"]) + _counting(inner["count"])
    point = np.concatenate([*single, np.zeros(0, np.int64)]).astype(np.int64)
    nearest = squares(points[point], entries).argmin(1) if len(point) else point
    return np.concatenate(begin), np.concatenate(end), np.concatenate(entry), point, nearest


def _counting(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def totals(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points per entry and their sums; subtrees by cumulative sums."""
    begin, end, entry, point, nearest = settle(points, nodes, entries)
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    count = np.bincount(entry, weights=end - begin, minlength=len(entries)).astype(np.int64)
    count += np.bincount(nearest, minlength=len(entries))
    total = np.zeros(entries.shape, np.int64)
    np.add.at(total, entry, sums[end] - sums[begin])
    np.add.at(total, nearest, points[point])
    return count, total


def assignment(points: np.ndarray, nodes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    begin, end, entry, point, nearest = settle(points, nodes, entries)
    out = np.empty(len(points), np.int64)
    size = (end - begin).astype(np.int64)
    out[np.repeat(begin, size) + _counting(size)] = np.repeat(entry, size)
    out[point] = nearest
    return out


def _trees(size: int, parts: int, block: int):
    """Tasks' rows in blocks: one row per block with its ids, labels and trees."""
    width = size // parts

    def pack(number: int, ids: list, labels: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        values = integers(np.concatenate(rows))
        points, places, nodes = [], [], []
        for p in range(parts):
            own = values[:, p * width : (p + 1) * width]
            order, tree = cover_tree(own)
            points.append(own[order].astype("<i4").tobytes())
            places.append(order.astype("<i4").tobytes())
            nodes.append(tree.tobytes())
        missing = np.array([i is None for i in ids])
        numbers = np.array([0 if i is None else i for i in ids], "<i8")
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.list_(pa.binary())] * 3]
        row = [number, numbers.tobytes(), np.packbits(missing).tobytes(), labels, points, places, nodes]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")]
        )

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, labels, rows, held = [], [], [], 0
        for batch in source:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                ids += part.column("vec_id").to_pylist()
                labels += part.column("label").to_pylist()
                rows.append(part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))
                held += part.num_rows
                while held >= block:
                    whole = np.concatenate(rows)
                    yield pack(number, ids[:block], labels[:block], [whole[:block]])
                    number += 1
                    ids, labels, rows, held = ids[block:], labels[block:], [whole[block:]], held - block
        if held:
            yield pack(number, ids, labels, rows)

    return run


def _views(row: dict, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for points, place, nodes in zip(row["points"], row["places"], row["nodes"], strict=True):
        yield (
            np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(place, "<i4"), np.frombuffer(nodes, NODE)
        )


class Codebooks:
    """Entries per part position, and the table of trees they were fitted on."""

    def __init__(self, entries: list[np.ndarray], trees: DataFrame | None):
        self.entries, self.trees = entries, trees

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for v in part.ravel().tolist()).encode()).hexdigest()


def fit(
    vectors: DataFrame, label: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors, label)
    # Only the one most common length reaches the driver.
    common = rows.groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, None)
    size = common["size"]
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    width = size // parts
    kept = rows.where(F.size("e") == size)
    first = kept.select("vec_id", "e").orderBy(F.asc_nulls_last("vec_id"), "e").limit(entries).collect()
    start = integers(np.array([r["e"] for r in first], np.float64))
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    path = fresh_path(spark, "codes")
    kept.select("vec_id", "label", "e").mapInArrow(_trees(size, parts, block), BLOCKS).write.parquet(path)
    trees = spark.read.schema(BLOCKS).parquet(path)
    for _ in range(rounds):
        books = _round(trees, books)
    return Codebooks(books, trees)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    width = books[0].shape[1]
    sums = [f"s{j}" for j in range(width)]

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in source:
            for row in batch.to_pylist():
                for p, (points, _, nodes) in enumerate(_views(row, width)):
                    c, t = totals(points, nodes, books[p])
                    count[p] += c
                    total[p] += t
        for p in range(len(books)):
            used = np.flatnonzero(count[p])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p)), pa.array(used), pa.array(count[p][used]), *(pa.array(total[p][used, j]) for j in range(width))],
                    ["part", "entry", "count", *sums],
                )

    schema = ", ".join(f"{c} long" for c in ("part", "entry", "count", *sums))
    # At most one row per entry of the codebooks.
    found = (
        trees.select("points", "places", "nodes").mapInArrow(run, schema).groupBy("part", "entry")
        .agg(*[F.sum(c).alias(c) for c in ("count", *sums)]).collect()
    )
    moved = [b.copy() for b in books]
    for r in found:
        moved[r["part"]][r["entry"]] = [r[s] // r["count"] for s in sums]
    return moved


def encode(books: Codebooks) -> DataFrame | None:
    """vec_id, label (as text), code and error of every vector that the codebooks were fitted on."""
    if books.trees is None:
        return None
    entries, width = books.entries, books.entries[0].shape[1]

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(ids)).astype(bool)
                codes, error = np.empty((len(ids), len(entries)), ">u2"), np.zeros(len(ids), np.int64)
                for p, (points, place, nodes) in enumerate(_views(row, width)):
                    to = assignment(points, nodes, entries[p])
                    codes[place, p] = to
                    error[place] += ((points - entries[p][to]) ** 2).sum(1)
                digits = 2 if len(entries[0]) <= 256 else 4
                text = codes.tobytes().hex() if digits == 4 else codes.astype(np.uint8).tobytes().hex()
                step = digits * len(entries)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=missing), pa.array(row["labels"], pa.string()),
                        pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return books.trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors that codes stand for, as arrays of doubles: ``vec_id``, ``embedding``."""
    entries = books.entries
    digits = 2 if len(entries[0]) <= 256 else 4

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [
                np.concatenate([e[int(c[digits * p : digits * (p + 1)], 16)] for p, e in enumerate(entries)]) / SCALE
                for c in batch.column("code").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "embedding"]
            )

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    spark = vectors.sparkSession
    books = fit(vectors, "label")
    codes = encode(books)
    if codes is None:
        kinds = [("vec_id", T.LongType()), ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())]
        return spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in kinds]))
    path = fresh_path(spark, "codes")
    marked = F.coalesce(F.concat(F.lit("s"), F.col("label")), F.lit("n"))
    codes.select("vec_id", "code", "error", marked.alias("label")).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = dimension_join(rows, sums, ["label"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := CAST(n + m - 2 * dot AS BIGINT), k := k)) AS s FROM (
    SELECT x.r, x.p, c.k, list_dot_product(x.x, x.x) AS n, list_dot_product(c.x, c.x) AS m, list_dot_product(x.x, c.x) AS dot
    FROM x JOIN c{k} c ON x.p = c.p) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, k, list(v ORDER BY j) AS x FROM (
    SELECT p, k, j, floor(sum(v) / count(*)) AS v FROM (
      SELECT a.p, a.s.k AS k, unnest(x.x) AS v, unnest(range(len(x.x))) AS j FROM a{k} a JOIN x ON a.r = x.r AND a.p = x.p)
    GROUP BY p, k, j) GROUP BY p, k),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.k = m.k)""")
    return ",\n".join(steps)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
    [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (
  SELECT r, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, r AS k, x FROM x WHERE r < {ENTRIES}),
{_sql()},
h AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (
    SELECT p, k, unnest(x) AS v, unnest(range(len(x))) AS j FROM c{ROUNDS})),
e AS (
  SELECT r, string_agg(lower(lpad(hex(s.k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e USING (r), h
"""
