"""Exact nearest patterns from a stored index of cells.

Each pattern belongs to its nearest centre, and the patterns of a centre are cut
by their distance to it into cells. A cell's least and greatest distance bound
from below how near any of its patterns can be to a query, by the triangle
inequality. A search runs in rounds: a query first meets its most promising
cell, then a few more, then all others that may still hold one of its ``k``
nearest; the k-th distance so far rules cells out. Results are exact.

Centres come from a bounded sample, so does their number; cells are bounded in
number as well, so the table of bounds may be everywhere. Cells lie together in
areas, a fixed number of them as long as an area fits a task: a query goes once
to each area that holds cells for it. An area of many rows is cut into boxes by
the values of a sample; then a query first meets the box it lies in, and later
goes only to boxes that its k-th distance so far reaches. A box that still holds
very many patterns, or that very many queries probe, is cut into blocks on both
sides (``pair_blocks``).
Inside a task small boxes of queries and patterns meet. The index lies on disk,
sorted by cell, and can be added to.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.functions.vectors import best_places, hit_table, joined, matrix, nearest_in_leaves, usable_rows
from gaugewatch.operators.scale import pair_blocks
from gaugewatch.operators.vector_tables import HIT_SCHEMA, best_hits, store_shape, stored_vectors, usable_vectors
from gaugewatch.session import fresh_path

ROWS_PER_CELL = 20_000
MAX_CENTRES = 512
MAX_CUTS = 256  # cells of one centre
SAMPLE = 8192
AREAS = 16  # parts of the index that meet queries; more where a part would exceed BLOCK_BYTES
AREA_ROWS = 500
BLOCK_BYTES = 32 << 20  # vectors of one side that a task holds
PARTS, PART_ROWS = 512, 1 << 12  # boxes that areas are cut into, about; and the least rows that make one
ROUNDS = (1, 8)  # cells a query meets in the first rounds; the last one takes all that are left
BOUND_SCHEMA = "cell int, rows bigint, low double, high double"
CENTRE_SCHEMA = "centre int, vector array<double>, cuts array<double>"
PLAN_SCHEMA = (
    "query_id bigint, embedding array<double>, kth double, met array<int>, seen int, cells array<int>, parts array<int>,"
    " n_cells bigint, compared bigint, open bigint"
)
BOX_SCHEMA = "part int, rows bigint, low array<double>, high array<double>"
SEED_SCHEMA = "query_id bigint, embedding array<double>, seen int"
PLAN_NAMES = [field.split()[0] for field in PLAN_SCHEMA.split(",")]


class CellIndex(NamedTuple):
    """Centres with the borders of their cells, the patterns by cell, and each cell's extent."""

    path: str
    centres: np.ndarray
    cuts: list[np.ndarray]
    rows: DataFrame
    bounds: DataFrame


class Tree(NamedTuple):
    """Where an area is cut: at a node, rows with less than ``value`` in dimension ``dim`` go left. Leaves name a part."""

    dim: np.ndarray
    value: np.ndarray
    children: np.ndarray
    part: np.ndarray

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        while (inner := np.flatnonzero(self.part[node] < 0)).size:
            at = node[inner]
            node[inner] = self.children[at, (vectors[inner, self.dim[at]] >= self.value[at]).astype(np.int64)]
        return self.part[node]


class Parts(NamedTuple):
    """The parts of all areas: each one's area, rows and box, and the trees of areas that were cut."""

    area: np.ndarray
    rows: np.ndarray
    low: np.ndarray | None
    high: np.ndarray | None
    trees: dict[int, Tree]

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Bounds from below of the squared distances of queries to the rows of every part."""
        gap = np.zeros((len(q), len(self.area)))
        if self.low is None:
            return gap
        low, high = np.ascontiguousarray(self.low.T), np.ascontiguousarray(self.high.T)
        step = max(1, (1 << 15) // len(self.area))  # what a core's cache holds
        for at in range(0, len(q), step):
            own = gap[at : at + step]
            for value, least, most in zip(q[at : at + step].T[:, :, None], low, high, strict=True):
                apart = least - value
                np.maximum(apart, value - most, out=apart)
                np.maximum(apart, 0.0, out=apart)
                apart *= apart
                own += apart
            own *= 1 - 1e-9
        return gap


class CellHits(NamedTuple):
    """Hits by rank; and per round: queries, cells met, patterns compared, and patterns there were for them."""

    hits: DataFrame
    report: DataFrame


def spread_centres(vectors: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of at most ``count`` groups of the vectors: farthest first, then some rounds of means."""
    chosen = [0]
    least = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(vectors)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        near = _distances(vectors, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = vectors[near == c].mean(0)
    return centres


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (vectors * vectors).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (vectors @ centres.T)
    return np.sqrt(np.maximum(square, 0.0))


def build_cells(
    patterns: DataFrame, path: str | None = None, rows_per_cell: int = ROWS_PER_CELL, carry: Sequence[str] = (), sample: int = SAMPLE
) -> CellIndex:
    """Write the index of all usable patterns, with the ``carry`` columns, to ``path``.

    The patterns are read three times: for the sample, for the cells' borders,
    and to be written. Pass a stored table.
    """
    spark = patterns.sparkSession
    path = path or fresh_path(spark, "cells")
    dim, count = store_shape(patterns)
    if dim is None:
        raise ValueError("no pattern has a usable embedding")
    slim = patterns.select(F.col("pattern_id").cast("bigint").alias("pattern_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = usable_vectors(slim, dim).orderBy(F.xxhash64("pattern_id"), "pattern_id").limit(sample)
    _, vectors = usable_rows(first.toArrow()["embedding"], dim)
    wanted = min(MAX_CENTRES, max(1, math.ceil(count / rows_per_cell)))
    centres = spread_centres(vectors, wanted)
    # A fixed number of percentiles for at most MAX_CENTRES centres.
    grid = [i / MAX_CUTS for i in range(1, MAX_CUTS)]
    told = slim.select("embedding").mapInArrow(_to_centre(centres, ()), "centre int, distance double")
    found = told.groupBy("centre").agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx("distance", grid, 10_000).alias("grid")
    ).collect()
    cuts = [np.zeros(0)] * len(centres)
    for row in found:
        parts = min(MAX_CUTS, math.ceil(row["rows"] / rows_per_cell))
        at = [round(i * MAX_CUTS / parts) - 1 for i in range(1, parts)]
        cuts[row["centre"]] = np.unique(np.array(row["grid"])[at])
    rows = [(c, vector.tolist(), cuts[c].tolist()) for c, vector in enumerate(centres)]
    spark.createDataFrame(rows, CENTRE_SCHEMA).coalesce(1).write.parquet(f"{path}/centres")
    _append(patterns, path, centres, cuts, list(carry), count, rows_per_cell)
    return load_cells(spark, path)


def _append(
    patterns: DataFrame, path: str, centres: np.ndarray, cuts: list[np.ndarray], carry: list[str], count: int, rows_per_cell: int
) -> None:
    """One more folder of patterns by cell, and one of their cells' extents. The extents come last: they make the batch count."""
    spark = patterns.sparkSession
    batch = fresh_path(spark, "batch").rsplit("/", 1)[1]
    slim = patterns.select(
        F.col("pattern_id").cast("bigint").alias("pattern_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        *[c for c in carry if c not in ("pattern_id", "embedding")],
    )
    more = [T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    placed = slim.mapInArrow(_to_centre(centres, cuts, slim.columns), T.StructType([*slim.schema.fields, *more]))
    # Small cells share a file.
    files = max(1, math.ceil(count / max(4 * rows_per_cell, _block_rows(centres.shape[1]) // 4)))
    placed.repartitionByRange(files, "cell", "distance").sortWithinPartitions("cell", "distance").write.parquet(f"{path}/rows/{batch}")
    written = spark.read.parquet(f"{path}/rows/{batch}")
    bounds = written.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("distance").alias("low"), F.max("distance").alias("high")
    )
    bounds.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{path}/bounds")


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    """A written index; batches whose extents were not written do not exist."""
    told = spark.read.schema(CENTRE_SCHEMA).parquet(f"{path}/centres").orderBy("centre").collect()  # at most MAX_CENTRES rows
    every = spark.read.schema(BOUND_SCHEMA + ", batch string").parquet(f"{path}/bounds")
    batches = [row["batch"] for row in every.select("batch").distinct().collect()]
    bounds = every.groupBy("cell").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = spark.read.parquet(*[f"{path}/rows/{b}" for b in sorted(batches)])
    return CellIndex(
        path, np.array([r["vector"] for r in told]), [np.array(r["cuts"], np.float64) for r in told], rows, bounds
    )


def add_to_cells(index: CellIndex, patterns: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> CellIndex:
    """The index with more patterns: in the same cells, whose extents grow with them."""
    spark = patterns.sparkSession
    carry = [c for c in index.rows.columns if c not in ("cell", "distance")]
    _append(patterns, index.path, index.centres, index.cuts, carry, store_shape(patterns)[1], rows_per_cell)
    return load_cells(spark, index.path)


def _to_centre(centres: np.ndarray, cuts: Sequence[np.ndarray], names: Sequence[str] = ()):
    """Each usable vector's nearest centre and distance, or, with cuts, all its columns, distance and cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            known, v = usable_rows(batch.column("embedding"), centres.shape[1])
            if not len(known):
                continue
            far = _distances(v, centres)
            near = far.argmin(1)
            far = far[np.arange(len(near)), near]
            if not names:
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far)], ["centre", "distance"])
                continue
            cell = near * MAX_CUTS
            for c in np.unique(near):
                own = near == c
                cell[own] += np.searchsorted(cuts[c], far[own])
            taken = batch.take(pa.array(known.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(taken.column(n) for n in names), pa.array(far), pa.array(cell.astype(np.int32))], [*names, "distance", "cell"]
            )

    return run


def _areas(bounds: pd.DataFrame, dim: int) -> np.ndarray:
    """The number of each cell's area: neighbours in the list of cells, as many as make up an area's rows."""
    rows = bounds["rows"].to_numpy()
    each = min(_block_rows(dim), max(AREA_ROWS, math.ceil(rows.sum() / AREAS)))
    return np.unique((np.cumsum(rows) - rows) // each, return_inverse=True)[1].astype(np.int64)


def _tree(vectors: np.ndarray, count: int, part: int) -> Tree:
    """At most ``count`` parts, numbered from ``part``: the fullest is halved in its widest dimension, again and again."""
    dim, value, children, rows = [0], [0.0], [[0, 0]], {0: np.arange(len(vectors))}
    whole = set()
    while len(rows) < count and len(rows) > len(whole):
        node = max((n for n in rows if n not in whole), key=lambda n: len(rows[n]))
        mine = vectors[rows[node]]
        widest = int((mine.max(0) - mine.min(0)).argmax()) if len(mine) else 0
        line = np.sort(mine[:, widest])
        cut = line[len(line) // 2] if len(line) else 0.0
        if len(line) and cut == line[0]:
            cut = line[min(np.searchsorted(line, cut, "right"), len(line) - 1)]
        if not len(line) or cut == line[0]:
            whole.add(node)  # nothing to tell its rows apart by
            continue
        right = mine[:, widest] >= cut
        dim[node], value[node], children[node] = widest, cut, [len(dim), len(dim) + 1]
        mine = rows.pop(node)
        for side in (mine[~right], mine[right]):
            rows[len(dim)] = side
            dim.append(0), value.append(0.0), children.append([0, 0])
    names = np.full(len(dim), -1)
    names[sorted(rows)] = part + np.arange(len(rows))
    return Tree(np.array(dim), np.array(value), np.array(children), names)


def _parts(index: CellIndex, bounds: pd.DataFrame, area: np.ndarray, k: int) -> Parts:
    """Areas of many rows are cut by the values of a bounded sample; the parts' boxes come from all rows.

    Where boxes would spare little, as with unrelated vectors of many values, areas stay whole.
    """
    size, dim = pd.Series(bounds["rows"].to_numpy()).groupby(area).sum().to_numpy(), index.centres.shape[1]
    each = min(_block_rows(dim), max(PART_ROWS, math.ceil(size.sum() / PARTS)))
    names = np.unique(area)
    if size.max() <= each:
        return Parts(names, size, None, None, {})
    first = index.rows.select("cell", "pattern_id", "embedding").orderBy(F.xxhash64("pattern_id"), "pattern_id").limit(SAMPLE).toArrow()
    vectors, cell = matrix(first["embedding"]), bounds["cell"].to_numpy()
    own = area[np.searchsorted(cell, first["cell"].to_numpy())]
    trees, owner = {}, []
    for a, n in zip(names.tolist(), size.tolist(), strict=True):
        trees[a] = _tree(vectors[own == a], math.ceil(n / each), len(owner))
        owner += [a] * int((trees[a].part >= 0).sum())
    owner = np.array(owner)
    if _reached(vectors, _part_of(first["cell"], vectors, cell, area, trees), k) > 0.5:
        return Parts(names, size, None, None, {})

    def boxes(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = np.zeros(len(owner), np.int64)
        low, high = np.full((len(owner), dim), np.inf), np.full((len(owner), dim), -np.inf)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("embedding"))
                part = _part_of(batch.column("cell"), v, cell, area, trees)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
                met = part[order[cuts]]
                rows += np.bincount(part, minlength=len(owner))
                low[met] = np.minimum(low[met], np.minimum.reduceat(v[order], cuts, 0))
                high[met] = np.maximum(high[met], np.maximum.reduceat(v[order], cuts, 0))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(rows[some]), *(pa.array(list(x[some]), pa.list_(pa.float64())) for x in (low, high))],
            ["part", "rows", "low", "high"],
        )

    def united(table: pa.Table) -> pa.Table:
        low, high = matrix(table["low"]).min(0), matrix(table["high"]).max(0)
        return pa.table({
            "part": table["part"][:1].combine_chunks(), "rows": pa.array([pc.sum(table["rows"]).as_py()]),
            "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())),
        })

    told = index.rows.select("cell", "embedding").mapInArrow(boxes, BOX_SCHEMA).groupBy("part").applyInArrow(united, BOX_SCHEMA)
    rows = np.zeros(len(owner), np.int64)
    low, high = np.full((len(owner), dim), np.inf), np.full((len(owner), dim), -np.inf)
    for row in told.collect():  # a row per part
        rows[row["part"]], low[row["part"]], high[row["part"]] = row["rows"], row["low"], row["high"]
    return Parts(owner, rows, low, high, trees)


def _reached(vectors: np.ndarray, part: np.ndarray, k: int, asked: int = 256) -> float:
    """The share of a sample's boxes that are as near to some of its vectors as their ``k`` nearest in it."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
    low, high = (f.reduceat(vectors[order], cuts, 0) for f in (np.minimum, np.maximum))
    q = vectors[:asked]
    far = _distances(q, vectors) ** 2
    kth = np.partition(far, k, axis=1)[:, k] if k < len(vectors) else np.full(len(q), np.inf)
    return float((Parts(cuts, cuts, low, high, {}).gaps(q) <= kth[:, None]).mean())


def _part_of(column: pa.Array, vectors: np.ndarray, cell: np.ndarray, area: np.ndarray, trees: dict[int, Tree]) -> np.ndarray:
    """The part of each row: its area, or what the area's tree says."""
    own = area[np.searchsorted(cell, np.asarray(column))]
    if not trees:
        return own
    part = np.empty(len(own), np.int64)
    for a in np.unique(own):
        mine = np.flatnonzero(own == a)
        part[mine] = trees[a].parts(vectors[mine])
    return part


def _block_rows(dim: int) -> int:
    return max(1, BLOCK_BYTES // (8 * dim))


def _plan(centres: np.ndarray, bounds: pd.DataFrame, area: np.ndarray, parts: Parts, take: int | None):
    """Where every query goes next: to the nearest ``take`` cells by their bounds that the k-th distance allows, or to all it allows.

    ``met`` are the cells of the rounds before. The last round names no cells,
    only their areas' parts: there may be very many of them.
    """
    cell, rows, low, high = (bounds[c].to_numpy() for c in ("cell", "rows", "low", "high"))
    owner = cell // MAX_CUTS
    longest = float(np.sqrt((centres * centres).sum(1)).max())
    starts = np.unique(area, return_index=True)[1]

    def lists(chosen: np.ndarray, values: np.ndarray) -> pa.ListArray:
        ends = np.r_[0, np.cumsum(chosen.sum(1))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[np.nonzero(chosen)[1]].astype(np.int32)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // max(len(cell), len(parts.area)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q = matrix(part.column("embedding"))
                kth = part.column("kth").to_numpy(zero_copy_only=False)
                far = _distances(q, centres)[:, owner]
                # Covers the rounding of distances.
                slack = 2e-7 * (np.sqrt((q * q).sum(1)) + longest)[:, None]
                gap = np.maximum(np.maximum(far - high, low - far) - slack, 0.0)
                allowed = gap * gap <= (kth * (1 + 1e-9))[:, None]
                row, known = _flat(part.column("met"))
                allowed[row, np.searchsorted(cell, known)] = False
                chosen = allowed
                if take is not None and take < len(cell):
                    # Complex numbers are ordered by their real part, then by the other: by bound, then by distance.
                    near = np.argpartition(np.where(allowed, gap + 1j * far, np.inf), take - 1, axis=1)[:, :take]
                    chosen = np.zeros_like(allowed)
                    np.put_along_axis(chosen, near, np.take_along_axis(allowed, near, 1), 1)
                counts = chosen.sum(1)
                travels = np.logical_or.reduceat(chosen, starts, axis=1)[:, parts.area]
                if parts.trees:
                    travels &= parts.gaps(q) <= (kth * (1 + 1e-9))[:, None]
                    seen = part.column("seen").to_numpy(zero_copy_only=False)
                    travels[np.arange(len(q)), seen] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("query_id"), part.column("embedding"), part.column("kth"), part.column("met"),
                        part.column("seen"), lists(chosen if take is not None else np.zeros_like(chosen), cell),
                        lists(travels, np.arange(len(parts.area))), pa.array(counts.astype(np.int64)),
                        pa.array((chosen @ rows).astype(np.int64)), pa.array((allowed.sum(1) - counts).astype(np.int64)),
                    ],
                    PLAN_NAMES,
                )

    return run


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return (
        pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64),
        pc.list_flatten(column).to_numpy(zero_copy_only=False),
    )


def search_cells(
    queries: DataFrame, index: CellIndex, k: int = 5, exclude_self: bool = False, rows_per_block: int = 20_000,
    rounds: Sequence[int] = ROUNDS,
) -> CellHits:
    """The exact ``k`` nearest patterns of every usable query: (query_id, rank, pattern_id, distance).

    A query travels to areas and their boxes, not to cells, so that what moves does
    not grow with the number of cells. ``rows_per_block`` patterns are compared at once.
    """
    spark = queries.sparkSession
    dim = index.centres.shape[1]
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    path = fresh_path(spark, "rounds")
    bounds = index.bounds.orderBy("cell").toPandas()  # at most MAX_CENTRES * MAX_CUTS rows
    area = _areas(bounds, dim)
    parts, most = _parts(index, bounds, area, k), _block_rows(dim)
    cell = bounds["cell"].to_numpy()

    def meet(named: DataFrame, mode: str) -> DataFrame | None:
        """Hits of queries, each with the part where it goes; None if they go nowhere."""
        probed = named.groupBy("part").count().toPandas()  # a row per part
        if probed.empty:
            return None
        wanted = np.zeros(len(parts.area), bool)
        wanted[probed["part"]] = True

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = _part_of(batch.column("cell"), matrix(batch.column("embedding")), cell, area, parts.trees)
                    # Only the probed parts move.
                    yield batch.append_column("part", pa.array(own.astype(np.int32))).filter(pa.array(wanted[own]))

        rows = index.rows.select(F.col("cell").cast("int"), F.col("pattern_id").cast("bigint"), F.col("embedding").cast("array<double>"))
        rows = rows.mapInArrow(placed, "cell int, pattern_id bigint, embedding array<double>, part int")
        blocks = [
            (int(a), math.ceil(n / most), math.ceil(parts.rows[a] / most))
            for a, n in zip(probed["part"], probed["count"], strict=True) if max(n, parts.rows[a]) > most
        ]
        work = _meet(k, exclude_self, mode, rows_per_block)
        return pair_blocks(named, rows, ["part"], "query_id", "pattern_id", work, HIT_SCHEMA, blocks=blocks)

    def best_written(hits: DataFrame, name: str) -> None:
        best_hits(hits if not found else hits.unionByName(found[-1]), k).drop("rank").write.parquet(f"{path}/hits-{name}")
        found.append(spark.read.schema(HIT_SCHEMA).parquet(f"{path}/hits-{name}"))

    def with_kth(going: DataFrame) -> DataFrame:
        kth = found[-1].groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(math.inf)).alias("kth")
        )
        return going.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(math.inf)))

    found, plans = [], []
    none = F.array().cast("array<int>")
    if parts.trees:
        # The same task checks and seeds: the vectors are written once.
        rows = asked.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        rows.mapInArrow(_seed(parts, dim), SEED_SCHEMA).write.parquet(f"{path}/seeds")
        seeds = spark.read.schema(SEED_SCHEMA).parquet(f"{path}/seeds")
        hits = meet(seeds.select("query_id", "embedding", F.lit(math.inf).alias("kth"), F.col("seen").alias("part")), "all")
        if hits is not None:
            best_written(hits, "seeds")
        state = (with_kth(seeds) if found else seeds.withColumn("kth", F.lit(math.inf))).withColumn("met", none)
    else:
        state = stored_vectors(asked, ["query_id"], dim).withColumns({"kth": F.lit(math.inf), "met": none, "seen": F.lit(-1)})
    for number, take in enumerate([*rounds, None]):
        state.select("query_id", "embedding", "kth", "met", "seen").mapInArrow(
            _plan(index.centres, bounds, area, parts, take), PLAN_SCHEMA
        ).write.parquet(f"{path}/plan-{number}")
        plan = spark.read.schema(PLAN_SCHEMA).parquet(f"{path}/plan-{number}")
        plans.append(plan.withColumn("round", F.lit(number + 1)))
        hits = meet(
            plan.select("query_id", "embedding", "kth", "met", "cells", F.explode("parts").alias("part")),
            "cells" if take is not None else "rest",
        )
        if hits is not None:
            best_written(hits, str(number))
        if take is not None and not plan.filter("open > 0").limit(1).count():
            break  # a cell that the k-th distance has ruled out stays so
        going = plan.filter("open > 0").select("query_id", "embedding", "seen", F.concat("met", "cells").alias("met"))
        state = with_kth(going) if found else going.withColumn("kth", F.lit(math.inf))
    every = plans[0]
    for plan in plans[1:]:
        every = every.unionByName(plan)
    report = every.groupBy("round").agg(
        F.count_if(F.col("n_cells") > 0).alias("queries"), F.sum("n_cells").alias("cells"),
        F.sum("compared").alias("compared"), (F.count(F.lit(1)) * F.lit(int(bounds["rows"].sum()))).alias("possible"),
    )
    if not found:
        found = [spark.createDataFrame([], HIT_SCHEMA)]
    return CellHits(best_hits(found[-1], k).select("query_id", "rank", "pattern_id", "distance"), report)


def _seed(parts: Parts, dim: int):
    """Usable queries with the part that each one meets first: it lies in it, or near it, and not far from its middle."""
    some = np.flatnonzero(parts.rows)
    box = Parts(some, parts.rows[some], parts.low[some], parts.high[some], {})
    middle = 0.5 * (box.low + box.high)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            known, q = usable_rows(batch.column("embedding"), dim)
            seen = [np.zeros(0, np.int64)]
            step = max(1, (1 << 20) // len(some))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                seen.append(some[(box.gaps(part) + 0.1 * _distances(part, middle) ** 2).argmin(1)])
            batch = batch.take(pa.array(known.astype(np.int64)))
            yield batch.append_column("seen", pa.array(np.concatenate(seen).astype(np.int32)))

    return run


def _meet(k: int, exclude_self: bool, mode: str, at_once: int):
    """Queries with all patterns, with those of the cells they name, or with the rest, of cells not met before."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_table([], [], [])
        qid, q, kth = left["query_id"].to_numpy(), matrix(left["embedding"]), left["kth"].to_numpy()
        ids, v, cell = right["pattern_id"].to_numpy(), matrix(right["embedding"]), right["cell"].to_numpy()
        if mode == "all":
            row, col, far = nearest_in_leaves(qid, q, kth, ids, v, k, exclude_self, None, at_once)
            return hit_table(qid[row], ids[col], far)
        if mode == "rest":
            row, known = _flat(left["met"])
            counts = np.bincount(row, minlength=len(qid))
            met = np.full((len(qid), max(1, int(counts.max()))), -1)
            met[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = known

            def barred(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
                return (met[rows] == cell[cols][:, None]).any(1)

            row, col, far = nearest_in_leaves(qid, q, kth, ids, v, k, exclude_self, barred, at_once)
            return hit_table(qid[row], ids[col], far)
        row, wanted = _flat(left["cells"])
        asks, holds = np.argsort(wanted, kind="stable"), np.argsort(cell, kind="stable")
        parts = []
        for c in np.intersect1d(wanted, cell):
            rows = row[asks[slice(*np.searchsorted(wanted, [c, c + 1], sorter=asks))]]
            mine = holds[slice(*np.searchsorted(cell, [c, c + 1], sorter=holds))]
            r, m, far = nearest_in_leaves(qid[rows], q[rows], kth[rows], ids[mine], v[mine], k, exclude_self, None, at_once)
            parts.append((rows[r], mine[m], far))
        row, col, far = joined(parts)
        keep = best_places(row, ids[col], far, k)
        return hit_table(qid[row[keep]], ids[col[keep]], far[keep])

    return run
