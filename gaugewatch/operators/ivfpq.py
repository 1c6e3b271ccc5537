"""Approximate nearest patterns: cells around centres, and codes of what is left, in a table that grows.

A model (centres and one codebook per sub-space) is trained once and named by
its contents. An index is a folder: the model, the coded patterns in one folder
per batch, and a ledger of finished batches with the model they were coded by.
A batch counts once its ledger row is written, so a job that died leaves nothing
behind, and codes of one model are never read with another.

A search meets the ``nprobe`` nearest cells of each query. With a filter, the
counts of matching patterns per cell decide how many more are probed, until
``k`` hits can exist. Codes below a measured size are broadcast, and a query is
searched where it lies; others meet the queries in blocks of cells.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.functions.vectors import (
    TILE, Codes, best_places, hit_table, joined, matrix, nearest_codes, squared_rows, usable_rows,
)
from gaugewatch.operators.scale import dimension_join, pair_blocks
from gaugewatch.operators.vector_tables import HIT_SCHEMA, best_hits, store_dim, stored_vectors
from gaugewatch.session import cut, fresh_path

MODEL_SCHEMA = "version string, made int, part int, entry int, vector array<double>"
HELD_CELLS = 1 << 18  # distances of queries to patterns that a task holds at once
BROADCAST_CODE_BYTES = 64 << 20
TASK_PAIRS = 1 << 30  # queries times codes of a task
BLOCK_BYTES = 32 << 20  # vectors of one side that a task holds to rank candidates
CANDIDATE_SCHEMA = "query_id bigint, embedding array<double>, ids array<bigint>"
CANDIDATES = [field.split()[0] for field in CANDIDATE_SCHEMA.split(", ")]
BATCH_SCHEMA = "batch string, version string, rows bigint"


class IvfPqModel(NamedTuple):
    """Centres of the cells, one codebook per sub-space, and a name that changes with them."""

    version: str
    centres: np.ndarray
    codebooks: np.ndarray


class IvfPqIndex(NamedTuple):
    """A model and the patterns coded by it: cell, pattern_id, code (a byte per sub-space), carried columns."""

    path: str
    model: IvfPqModel
    codes: DataFrame


def ivfpq_model(centres: np.ndarray, codebooks: np.ndarray) -> IvfPqModel:
    """A model from given centres (cells by size) and codebooks (sub-spaces by entries by width)."""
    centres, codebooks = np.ascontiguousarray(centres, np.float64), np.ascontiguousarray(codebooks, np.float64)
    if codebooks.shape[0] * codebooks.shape[2] != centres.shape[1] or codebooks.shape[1] > 256:
        raise ValueError("codebooks must cover the centres' dimensions, with at most 256 entries each")
    named = hashlib.sha256(repr((centres.shape, codebooks.shape)).encode() + centres.tobytes() + codebooks.tobytes())
    return IvfPqModel(named.hexdigest()[:16], centres, codebooks)


def _kmeans(df: DataFrame, column: Column, k: int, seed: int, rounds: int) -> np.ndarray:
    vectors = df.select(array_to_vector(column).alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=rounds, initMode="random").fit(vectors).clusterCenters())


def ivfpq_train(
    patterns: DataFrame, nlist: int = 100, m: int = 8, bits: int = 8, seed: int = 42, rounds: int = 10
) -> IvfPqModel:
    """Cluster all usable patterns into ``nlist`` cells and what is left, in ``m`` parts, into 2**bits entries."""
    dim = store_dim(patterns)
    if dim is None:
        raise ValueError("no pattern has a usable embedding")
    if dim % m:
        raise ValueError(f"{dim} dimensions cannot be cut into {m} equal parts")
    known = stored_vectors(patterns.select("pattern_id", "embedding"), ["pattern_id"], dim)
    centres = _kmeans(known, F.col("embedding"), nlist, seed, rounds)
    rests = cut(known.mapInArrow(_nearest_cell(centres), "rest array<double>"))
    width, books = dim // m, []
    for j in range(m):
        found = _kmeans(rests, F.slice("rest", j * width + 1, width), 2**bits, seed + j, rounds)
        # Fewer distinct vectors than entries: the last one is repeated and never chosen.
        books.append(np.concatenate([found, np.repeat(found[-1:], 2**bits - len(found), 0)]))
    return ivfpq_model(centres, np.array(books))


def _far(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (v * v).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (v @ centres.T)


def _nearest_cell(centres: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("embedding"))
                rest = v - centres[_far(v, centres).argmin(1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(rest), pa.list_(pa.float64()))], ["rest"])

    return run


# --- the table --------------------------------------------------------------------------------


def ivfpq_create(patterns: DataFrame, model: IvfPqModel, path: str | None = None, carry: Sequence[str] = ()) -> IvfPqIndex:
    """A new index of all usable patterns; ``carry`` names columns to filter by."""
    spark = patterns.sparkSession
    path = path or fresh_path(spark, "ivfpq")
    rows = [(model.version, 0, -1, i, v.tolist()) for i, v in enumerate(model.centres)]
    rows += [(model.version, 0, j, i, v.tolist()) for j, book in enumerate(model.codebooks) for i, v in enumerate(book)]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.parquet(f"{path}/model")
    _append(patterns, path, model, list(carry))
    return ivfpq_load(spark, path)


def ivfpq_add(index: IvfPqIndex, patterns: DataFrame) -> IvfPqIndex:
    """The index with more patterns, coded by the index's own model; nothing is trained or coded again."""
    carry = [c for c in index.codes.columns if c not in ("cell", "pattern_id", "code")]
    _append(patterns, index.path, index.model, carry)
    return ivfpq_load(patterns.sparkSession, index.path)


def ivfpq_load(spark: SparkSession, path: str, version: str | None = None) -> IvfPqIndex:
    """A written index; with ``version``, only if that is its model."""
    rows = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/model").orderBy("part", "entry").collect()  # of the model's size
    centres = np.array([r["vector"] for r in rows if r["part"] < 0])
    parts = 1 + max(r["part"] for r in rows)
    model = ivfpq_model(centres, np.array([[r["vector"] for r in rows if r["part"] == j] for j in range(parts)]))
    found = rows[0]["version"]
    if found != model.version or version not in (None, found):
        raise ValueError(f"the index at {path} has model {found}, not {version or model.version}")
    ledger = spark.read.schema(BATCH_SCHEMA).parquet(f"{path}/batches").collect()
    if {r["version"] for r in ledger} - {found}:
        raise ValueError(f"the index at {path} holds codes of another model than {found}")
    return IvfPqIndex(path, model, spark.read.parquet(*sorted(f"{path}/codes/{r['batch']}" for r in ledger)))


def _append(patterns: DataFrame, path: str, model: IvfPqModel, carry: list[str]) -> None:
    spark = patterns.sparkSession
    batch = fresh_path(spark, "batch").rsplit("/", 1)[1]
    rows = patterns.select(
        F.col("pattern_id").cast("bigint").alias("pattern_id"), F.col("embedding").cast("array<double>").alias("embedding"), *carry
    )
    names = ["pattern_id", *carry]
    schema = T.StructType(
        [T.StructField("cell", T.IntegerType()), *(rows.schema[n] for n in names), T.StructField("code", T.BinaryType())]
    )
    coded = rows.mapInArrow(_codes(model, names), schema)
    # Cells lie together, so that a probe of few cells reads few row groups.
    coded.sortWithinPartitions("cell").write.parquet(f"{path}/codes/{batch}")
    count = spark.read.schema(schema).parquet(f"{path}/codes/{batch}").count()
    ledger = spark.createDataFrame([(batch, model.version, count)], BATCH_SCHEMA)
    ledger.coalesce(1).write.mode("append").parquet(f"{path}/batches")


def _codes(model: IvfPqModel, names: Sequence[str]):
    books = model.codebooks
    m, _, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            known, v = usable_rows(batch.column("embedding"), model.centres.shape[1])
            if not len(known):
                continue
            cells = _far(v, model.centres).argmin(1)
            rest = v - model.centres[cells]
            codes = np.empty((len(v), m), np.uint8)
            for j, book in enumerate(books):
                codes[:, j] = _far(rest[:, j * width : (j + 1) * width], book).argmin(1)
            taken = batch.take(pa.array(known.astype(np.int64)))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(v), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), *(taken.column(n) for n in names), raw.cast(pa.binary())], ["cell", *names, "code"]
            )

    return run


# --- search -----------------------------------------------------------------------------------------


def _probes(model: IvfPqModel, nprobe: int, need: int, by: str | None, everywhere: dict[int, int] | None):
    """(query, key, cell, embedding) for each probed cell that holds patterns that count.

    Cells come in the order of their centres' distance: the first ``nprobe``,
    and more while those before hold fewer than ``need`` patterns that count.
    """
    centres = model.centres

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if by is None:
                counts = np.zeros(len(centres), np.int64)
                for cell, n in everywhere.items():
                    counts[cell] = n
            else:
                counts = np.zeros((batch.num_rows, len(centres)), np.int64)
                for i, found in enumerate(batch.column("held_").to_pylist()):
                    for cell in found or ():
                        counts[i, cell["cell"]] = cell["n"]
            order, probed = _probed(matrix(batch.column("embedding")), centres, counts, nprobe, need)
            row, place = np.nonzero(probed)
            out = [batch.column("query_id").take(pa.array(row)), pa.array(order[row, place].astype(np.int32))]
            names = ["query_id", "cell"]
            if by is not None:
                out.append(batch.column(by).take(pa.array(row)))
                names.append(by)
            yield pa.RecordBatch.from_arrays([*out, batch.column("embedding").take(pa.array(row))], [*names, "embedding"])

    return run


def _probed(v: np.ndarray, centres: np.ndarray, counts: np.ndarray, nprobe: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Every query's cells by distance, and which of them it probes; ``counts`` are the patterns that count, by cell."""
    order = np.argsort(_far(v, centres), axis=1, kind="stable")
    held = np.take_along_axis(np.broadcast_to(counts, order.shape), order, 1)
    before = np.cumsum(held, axis=1) - held
    return order, ((np.arange(len(centres)) < nprobe)[None, :] | (before < need)) & (held > 0)


def ivfpq_search(
    queries: DataFrame, index: IvfPqIndex, k: int = 5, nprobe: int = 10, where: Column | str | None = None, by: str | None = None,
    exclude_self: bool = False, refine: int = 0, patterns: DataFrame | None = None, rows_per_block: int = 20_000,
) -> DataFrame:
    """Approximate top ``k``: (query_id, rank, pattern_id, distance).

    ``where`` (a predicate on carried columns) and ``by`` (a carried column that
    query and pattern must share) filter before the search. With ``refine``,
    ``refine * k`` candidates by their codes are ranked by their exact distances
    to the vectors in ``patterns``. Distances are squared.
    """
    model = index.model
    books, centres = model.codebooks, model.centres
    wanted = k * max(refine, 1)
    need = wanted + int(exclude_self)
    keys = [by] if by else []
    codes = index.codes if where is None else index.codes.filter(where)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), *keys, "embedding")
    asked = stored_vectors(asked, ["query_id", *keys], centres.shape[1])
    if by:
        codes, asked = codes.filter(F.col(by).isNotNull()), asked.filter(F.col(by).isNotNull())
        # One row per key, with at most as many counts as there are cells.
        counted = codes.groupBy(by, "cell").agg(F.count(F.lit(1)).alias("n"))
        held = counted.groupBy(by).agg(F.collect_list(F.struct("cell", "n")).alias("held_"))
        told, everywhere = dimension_join(asked, held, [by]), None
    else:
        told, everywhere = asked, {r["cell"]: r["count"] for r in codes.groupBy("cell").count().collect()}
        if sum(everywhere.values()) * (len(books) + 8) <= BROADCAST_CODE_BYTES:
            found = _search_shared(asked, codes, model, wanted, nprobe, need, exclude_self, refine > 0)
            if refine:
                return _refined(found, asked.count(), patterns, centres.shape[1], k)
            return best_hits(found, k).select("query_id", "rank", "pattern_id", "distance")
    kind = f", `{by}` {dict(asked.dtypes)[by]}" if by else ""
    probes = cut(told.mapInArrow(
        _probes(model, nprobe, need, by, everywhere), f"query_id bigint, cell int{kind}, embedding array<double>"
    ))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_table([], [], [])
        qid, cell = left["query_id"].to_numpy(), left["cell"][0].as_py()
        store = _code_store(right, 0)
        everyone = np.ones((len(qid), 1), bool)
        row, col, far = nearest_codes(
            qid, matrix(left["embedding"]), everyone, np.zeros(len(qid), np.int64), store, centres[cell : cell + 1], books, wanted,
            exclude_self, HELD_CELLS // TILE,
        )
        return hit_table(qid[row], store.ids[col], far)

    met = codes.select("cell", *keys, "pattern_id", "code")
    hits = pair_blocks(probes, met, ["cell", *keys], "query_id", "pattern_id", meet, HIT_SCHEMA, rows_per_block, rows_per_block)
    best = best_hits(hits, wanted)
    if refine:
        listed = best.groupBy("query_id").agg(F.collect_list("pattern_id").alias("ids"))
        found = asked.select("query_id", "embedding").join(listed, "query_id").select(*CANDIDATES)
        return _refined(found, asked.count(), patterns, centres.shape[1], k)
    return best.select("query_id", "rank", "pattern_id", "distance")


def _code_store(table: pa.Table, cells: int) -> Codes:
    """Codes by cell; without cells, as those of one."""
    cell = table["cell"].to_numpy() if cells else np.zeros(table.num_rows, np.int32)
    order = np.argsort(cell, kind="stable")
    raw = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return Codes(table["pattern_id"].to_numpy()[order], raw[order], np.searchsorted(cell[order], np.arange(max(cells, 1) + 1)))


def _search_shared(
    asked: DataFrame, codes: DataFrame, model: IvfPqModel, wanted: int, nprobe: int, need: int, exclude_self: bool, listed: bool
) -> DataFrame:
    """Every task meets its own queries with all codes: only the queries are dealt out, once.

    Hits, or, ``listed``, the queries with a list of the patterns found.
    """
    spark = asked.sparkSession
    table = codes.select("cell", "pattern_id", "code").toArrow()  # at most BROADCAST_CODE_BYTES
    shared = spark.sparkContext.broadcast((_code_store(table, len(model.centres)), model))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(asked.count() * table.num_rows / TASK_PAIRS))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        (store, model), centres = shared.value, shared.value[1].centres
        for batch in batches:
            if not batch.num_rows or not len(store.ids):
                continue
            qid, q = batch.column("query_id").to_numpy(), matrix(batch.column("embedding"))
            order, chosen = _probed(q, centres, np.diff(store.starts), nprobe, need)
            probed = np.zeros_like(chosen)
            np.put_along_axis(probed, order, chosen, 1)
            first = order[np.arange(len(q)), chosen.argmax(1)]
            row, col, far = nearest_codes(
                qid, q, probed, first, store, centres, model.codebooks, wanted, exclude_self, HELD_CELLS // TILE
            )
            if not listed:
                yield from hit_table(qid[row], store.ids[col], far).to_batches()
                continue
            order = np.argsort(row, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(q)))].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(store.ids[col[order]]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), ids], CANDIDATES)

    return asked.repartition(parts, "query_id").mapInArrow(search, CANDIDATE_SCHEMA if listed else HIT_SCHEMA)


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """A block for every id, whatever ids have in common."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % blocks


def _refined(found: DataFrame, asked: int, patterns: DataFrame | None, dim: int, k: int) -> DataFrame:
    """The ``k`` candidates of each of the ``asked`` queries that are nearest by their exact distances.

    Patterns lie in hashed blocks. A query travels once to each block that has
    candidates of it, with their ids, so that no vector moves once per pair.
    """
    if patterns is None:
        raise ValueError("refine needs the patterns with their vectors")
    known = stored_vectors(
        patterns.select(F.col("pattern_id").cast("bigint").alias("pattern_id"), "embedding"), ["pattern_id"], dim
    )
    rows = max(1, BLOCK_BYTES // (8 * dim))
    rights, lefts = (max(1, math.ceil(count / rows)) for count in (known.count(), asked))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            block = _block_of(ids, rights)
            # Some queries at a time: each goes out as often as there are blocks for it.
            step = max(1, rows // (4 * rights))
            for at in range(0, batch.num_rows, step):
                a, e = np.searchsorted(row, [at, at + step])
                if a == e:
                    continue
                order = a + np.lexsort((block[a:e], row[a:e]))
                key = row[order] * rights + block[order]
                cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                ends = pa.array(np.r_[cuts, len(key)].astype(np.int32))
                taken = batch.take(pa.array(row[order[cuts]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken.column("query_id"), taken.column("embedding"), pa.ListArray.from_arrays(ends, pa.array(ids[order])),
                        pa.array(block[order[cuts]].astype(np.int32)),
                    ],
                    [*CANDIDATES, "block"],
                )

    def place(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            block = _block_of(batch.column("pattern_id").to_numpy(zero_copy_only=False), rights)
            yield batch.append_column("block", pa.array(block.astype(np.int32)))

    part = F.pmod(F.xxhash64("query_id"), F.lit(lefts)).cast("int").alias("part")
    left = found.mapInArrow(deal, f"{CANDIDATE_SCHEMA}, block int").select("*", part)
    every = F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("part")
    right = known.filter("pattern_id IS NOT NULL").mapInArrow(place, "pattern_id bigint, embedding array<double>, block int").select("*", every)

    def measure(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_table([], [], [])
        ids, v = right["pattern_id"].to_numpy(), matrix(right["embedding"])
        order = np.argsort(ids, kind="stable")
        qid, q, lists = left["query_id"].to_numpy(), matrix(left["embedding"]), left["ids"].combine_chunks()
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        chosen = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        # Rows that repeat an id all count, as in a join.
        low, high = (np.searchsorted(ids, chosen, side, sorter=order) for side in ("left", "right"))
        row, count = np.repeat(row, high - low), high - low
        col = order[np.arange(len(row)) + np.repeat(low - (np.cumsum(count) - count), count)]
        far = joined([
            (row[at : at + TILE], col[at : at + TILE], squared_rows(q[row[at : at + TILE]], v[col[at : at + TILE]]))
            for at in range(0, len(row), TILE)
        ])[2]
        keep = best_places(row, ids[col], far, k)
        return hit_table(qid[row[keep]], ids[col[keep]], far[keep])

    left, right = (side.groupBy(side["block"], side["part"]) for side in (left, right))
    hits = left.cogroup(right).applyInArrow(measure, HIT_SCHEMA)
    return best_hits(hits, k).select("query_id", "rank", "pattern_id", "distance")


def ivfpq_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Hits there are, those found, and their share, as one row."""
    both = exact.select("query_id", "pattern_id").join(
        found.select("query_id", "pattern_id", F.lit(1).alias("found")), ["query_id", "pattern_id"], "left"
    )
    return both.agg(
        F.count(F.lit(1)).alias("hits"), F.count("found").alias("found"),
        F.try_divide(F.count("found"), F.count(F.lit(1))).alias("recall"),
    )
