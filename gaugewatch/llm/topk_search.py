"""Exact inner-product top-k through a pivot-distance index.

Inner product becomes Euclidean distance with one more coordinate: with R the
largest norm, ``x`` is extended by ``sqrt(R^2 - |x|^2)`` and a query by 0, so
that ``|q - x|^2 = |q|^2 + R^2 - 2 q.x``. The nearest are the best.

1. A fixed number of pivots is chosen far apart from a bounded sample. Every
   vector, none left out, is keyed by its nearest pivot and its distance, and
   the sorted keys are cut into cells of bounded size. A cell is a part of one
   pivot's annulus, or a few annuli; a table of their radii is the index.
2. Every query searches its own cell, which gives a first k-th score.
3. The queries of a cell go, as a block, to those other cells which the
   triangle inequality does not rule out for all of them: for a pivot at
   distance d from the query, no vector of the annulus [low, high] is nearer
   than ``max(d - high, low - d, 0)``. There, annuli are expanded from the
   nearest on, until their bound is below the k-th score.
4. The best k of all cells are the result. Bounds have a slack for rounding,
   and a tie with the k-th score is never ruled out.

Components are ``floor(64 x)``; scores are exact integers. Vectors that are
null or hold null or non-finite components take no part, nor do rows without
an id. Vectors of different lengths never meet. Rows that repeat an id all take
part, each as a row of its own, whether their vectors are equal or not, but never
meet one another, and share one ranking. Ties go to the smaller id. Components
that leave 62 bits as integers, and products that may leave 63, raise an error.
An empty table gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewatch.session import fresh_path

K = 20
SCALE = 64
EVERY = 20
PIVOTS = 32
SAMPLE = 2000
CELL = 8192
MAX_CELLS = 65_536
ANNULUS = 512
PROBES = 64

VECTOR = "vec_id long, size int, ints binary, norm double, pivot int, distance double, cell int"
FOUND = "query_id long, vec_id long, score long"
PROBE = "cell int, part int, size int, ids binary, ints binary, kth binary"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, ints, norm): whole vectors as little-endian 64-bit integers, and their squared norm."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & usable)

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, ints, norms, sizes = [], [], [], []
            for vec_id, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.floor(SCALE * np.array(e, np.float64))
                if v.size and np.abs(v).max() >= 2.0**62:
                    raise ValueError("a component leaves the range of 64-bit integers")
                ids.append(vec_id)
                ints.append(v.astype("<i8").tobytes())
                norms.append(float(v @ v))
                sizes.append(len(e))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ints, pa.binary()), pa.array(norms, pa.float64())],
                ["vec_id", "size", "ints", "norm"],
            )

    return rows.mapInArrow(run, "vec_id long, size int, ints binary, norm double")


def _matrix(blobs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), size)


def _extended(v: np.ndarray, norm: np.ndarray, radius2: float) -> np.ndarray:
    return np.c_[v.astype(np.float64), np.sqrt(np.maximum(radius2 - norm, 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(rows: list[tuple[int, bytes, float]], radius2: float, count: int) -> dict[int, np.ndarray]:
    """Per vector length: extended vectors far apart, each the farthest from those before it."""
    out = {}
    for size in sorted({s for s, _, _ in rows}):
        own = [(b, n) for s, b, n in rows if s == size]
        points = _extended(_matrix([b for b, _ in own], size), np.array([n for _, n in own]), radius2)
        chosen = [0]
        far = _distances(points, points[:1])[:, 0]
        while len(chosen) < min(count, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
        out[size] = points[chosen]
    return out


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats as long as every sum is an exact one."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    largest = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if largest < 2**53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if largest >= 2**63:
        raise ValueError("inner products leave the range of 64-bit integers")
    return queries @ vectors.T


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best entries, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Cell:
    """Vectors of one cell and length, in the order of pivot and distance."""

    def __init__(self, table: pa.Table, size: int):
        table = table.filter(pa.compute.equal(table.column("size"), size)).sort_by(
            [("pivot", "ascending"), ("distance", "ascending"), ("vec_id", "ascending")]
        )
        self.ids = table.column("vec_id").to_numpy()
        self.vectors = _matrix(table.column("ints").to_pylist(), size)
        self.pivot, self.distance = table.column("pivot").to_numpy(), table.column("distance").to_numpy()
        cut = np.r_[True, self.pivot[1:] != self.pivot[:-1]]
        start = np.flatnonzero(cut)
        nth = np.arange(len(cut)) - np.repeat(start, np.diff(np.r_[start, len(cut)]))
        self.begin = np.flatnonzero(cut | (nth % ANNULUS == 0))
        self.end = np.r_[self.begin[1:], len(cut)]

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, pivots: np.ndarray, radius2: float, k: int):
        """Rows (query, id, score) that may be among the best k; ``kth`` is what a query has already."""
        norm = (queries.astype(np.float64) ** 2).sum(1)
        to_pivot = _distances(np.c_[queries.astype(np.float64), np.zeros(len(queries))], pivots)
        bound = upper_bounds(norm, to_pivot[:, self.pivot[self.begin]], self.distance[self.begin], self.distance[self.end - 1], radius2)
        out_id = [np.zeros(0, np.int64)] * len(queries)
        out_score = [np.zeros(0, np.int64)] * len(queries)
        kth = kth.copy()
        # Annuli from the most promising on; what is open shrinks as scores grow.
        for a in np.argsort(-bound.max(0), kind="stable").tolist():
            open_ = np.flatnonzero(bound[:, a] >= kth)
            if not len(open_):
                continue
            span = slice(self.begin[a], self.end[a])
            score, own = scores_of(queries[open_], self.vectors[span]), self.ids[span]
            for q, row in zip(open_.tolist(), score, strict=True):
                pick = np.flatnonzero((row >= kth[q]) & (own != ids[q]))
                if len(pick):
                    all_ids, all_scores = np.r_[out_id[q], own[pick]], np.r_[out_score[q], row[pick]]
                    top = best(all_ids, all_scores, k)
                    out_id[q], out_score[q] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        kth[q] = max(kth[q], out_score[q][-1])
        return out_id, out_score, kth


def upper_bounds(norm: np.ndarray, to_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, radius2: float) -> np.ndarray:
    """No vector of an annulus scores more: queries down, annuli across."""
    slack = 1e-6 * np.sqrt(radius2 + norm)[:, None] + 1e-6
    near = np.maximum(np.maximum(to_pivot - high, low - to_pivot) - slack, 0)
    return (norm[:, None] + radius2 - near * near) / 2 + 1


def _batch(query: list, ids: list, scores: list) -> pa.Table:
    counts = [len(i) for i in ids]
    return pa.table({
        "query_id": pa.array(np.repeat(np.array(query, np.int64), counts), pa.int64()),
        "vec_id": pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]), pa.int64()),
        "score": pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]).astype(np.int64), pa.int64()),
    })


LEAST = np.iinfo(np.int64).min


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, cell_rows: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    at = fresh_path(spark, "topk")
    integers(vectors).write.parquet(f"{at}/vectors")
    rows = spark.read.schema("vec_id long, size int, ints binary, norm double").parquet(f"{at}/vectors")
    count, radius2 = rows.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    sample = [tuple(r) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "ints").limit(SAMPLE).select("size", "ints", "norm").collect()]
    rest = [tuple(r) for r in rows.select("size").distinct().join(
        spark.createDataFrame([(s,) for s in {r[0] for r in sample}], "size int"), "size", "left_anti"
    ).join(rows, "size").groupBy("size").agg(*[F.min_by(c, F.struct("vec_id", "ints")) for c in ("ints", "norm")]).collect()]
    shared = spark.sparkContext.broadcast(choose_pivots(sample + rest, radius2, pivots))  # a fixed number per length
    cells = max(1, min(MAX_CELLS, math.ceil(count / cell_rows)))

    def key(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            size = batch.column("size").to_numpy()
            pivot, distance = np.zeros(len(size), np.int32), np.zeros(len(size))
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                points = _extended(_matrix([batch.column("ints")[int(i)].as_py() for i in own], s), batch.column("norm").to_numpy()[own], radius2)
                to = _distances(points, shared.value[s])
                pivot[own], distance[own] = to.argmin(1), to.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(distance)], [*batch.schema.names, "pivot", "distance"])

    keyed = rows.mapInArrow(key, VECTOR.rsplit(",", 1)[0])
    ranged = keyed.repartitionByRange(cells, "size", "pivot", "distance", "vec_id")
    ranged.withColumn("cell", F.spark_partition_id()).write.parquet(f"{at}/index")
    index = spark.read.schema(VECTOR).parquet(f"{at}/index")

    def own_cell(table: pa.Table) -> pa.Table:
        out, cell_no = [], table.column("cell")[0].as_py()
        for s in pa.compute.unique(table.column("size")).to_pylist():
            cell = Cell(table, s)
            mine = np.flatnonzero(cell.ids % every == 0)
            if len(mine):
                ids, queries = cell.ids[mine], cell.vectors[mine]
                found, score, kth = cell.search(ids, queries, np.full(len(ids), LEAST), shared.value[s], radius2, k)
                out.append((cell_no, s, ids.tobytes(), queries.tobytes(), kth.tobytes(), *_flat(found, score)))
        kinds = [("cell", pa.int32()), ("size", pa.int32()), *((n, pa.binary()) for n in ("ids", "ints", "kth", "counts", "found", "score"))]
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns, strict=True)})

    blocks = "cell int, size int, ids binary, ints binary, kth binary, counts binary, found binary, score binary"
    index.groupBy("cell").applyInArrow(own_cell, blocks).write.parquet(f"{at}/queries")
    own = spark.read.schema(blocks).parquet(f"{at}/queries")
    first = own.mapInArrow(_unfold, FOUND)
    # Radii of all annuli: at most MAX_CELLS + pivots rows per length.
    radii = index.groupBy("size", "pivot", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high")).toPandas()
    annuli = spark.sparkContext.broadcast({s: g[["pivot", "cell", "low", "high"]].to_numpy() for s, g in radii.groupby("size")})
    parts = max(1, math.ceil(cells / PROBES))

    def probe(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for block in batch.to_pylist():
                ids, kth = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["kth"], np.int64)
                queries = np.frombuffer(block["ints"], "<i8").reshape(len(ids), block["size"])
                table = annuli.value[block["size"]]
                norm = (queries.astype(np.float64) ** 2).sum(1)
                to = _distances(np.c_[queries.astype(np.float64), np.zeros(len(ids))], shared.value[block["size"]])
                bound = upper_bounds(norm, to[:, table[:, 0].astype(int)], table[:, 2], table[:, 3], radius2)
                out = []
                for cell in np.unique(table[:, 1]).astype(int).tolist():
                    keep = (bound[:, table[:, 1] == cell].max(1) >= kth) if cell != block["cell"] else np.zeros(len(ids), bool)
                    if keep.any():
                        out.append((cell, block["cell"] % parts, block["size"], ids[keep].tobytes(), queries[keep].tobytes(), kth[keep].tobytes()))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in PROBE.split(", ")]
                    )

    def other_cells(vectors: pa.Table, probes: pa.Table) -> pa.Table:
        query, ids, score = [], [], []
        sizes = {} if not vectors.num_rows else {s: Cell(vectors, s) for s in pa.compute.unique(probes.column("size")).to_pylist()}
        for p in probes.to_pylist() if sizes else []:
            own_ids, kth = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["kth"], np.int64)
            queries = np.frombuffer(p["ints"], "<i8").reshape(len(own_ids), p["size"])
            found, scored, _ = sizes[p["size"]].search(own_ids, queries, kth, shared.value[p["size"]], radius2, k)
            query += own_ids.tolist()
            ids += found
            score += scored
        return _batch(query, ids, score)

    own.mapInArrow(probe, PROBE).write.parquet(f"{at}/probes")
    probes = spark.read.schema(PROBE).parquet(f"{at}/probes")
    # A cell is copied for those parts only that probe it.
    probed = spark.read.schema(PROBE).parquet(f"{at}/probes").select("cell", "part").distinct()
    copies = index.join(probed, "cell")
    second = copies.groupBy("cell", "part").cogroup(probes.groupBy("cell", "part")).applyInArrow(other_cells, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _flat(found: list[np.ndarray], score: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    counts = np.array([len(f) for f in found], np.int64)
    return counts.tobytes(), np.concatenate(found).tobytes(), np.concatenate(score).astype(np.int64).tobytes()


def _unfold(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for row in batch.to_pylist():
            ids, counts, found, score = (np.frombuffer(row[c], np.int64) for c in ("ids", "counts", "found", "score"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"]
            )


SQL = f"""
WITH v AS (
  SELECT vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= {K}
"""
