"""Nearest patterns per query: exact, filtered, host-first and approximate.

A pattern table below a measured size is broadcast once; every query is then
searched and ranked where it lies, and its hits travel with it as an array, so
nothing is shuffled. A larger table meets the queries in blocks of bounded size
(``pair_blocks``). Either way a task only emits the best ``k`` patterns per
query and block; query-pattern pairs never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewatch.functions.columns import is_usable, shuffled_number
from gaugewatch.functions.vectors import (
    Store,
    arena_of,
    hit_table,
    matrix,
    ranks,
    rows_by_key,
    usable_rows,
)
from gaugewatch.operators.cells import CellIndex, build_cells, search_cells
from gaugewatch.operators.ivfpq import IvfPqIndex, ivfpq_search
from gaugewatch.operators.scale import dimension_join, pair_blocks
from gaugewatch.operators.vector_tables import (
    HIT_SCHEMA,
    best_hits,
    store_dim,
    stored_vectors,
    unusable_counts,  # noqa: F401  (offered here as well)
    usable_vectors,
)
from gaugewatch.session import cut

BROADCAST_VECTOR_BYTES = 64 << 20
HIT_COLUMNS = [
    "host_id", "activity", "ts", "is_anomaly", "anomaly_type", "description", "explanation", "readings",
]


# --- small or large store ---------------------------------------------------------------


def _meta_columns(patterns: DataFrame) -> list[Column]:
    """The carried columns, NULL where the pattern table lacks one."""
    types = dict(zip(HIT_COLUMNS, ["string", "string", "string", "boolean", *["string"] * 3, "map<string,double>"]))
    found = {c: (F.col(c) if c in patterns.columns else F.lit(None)).cast(types[c]) for c in HIT_COLUMNS}
    # A pattern without a flag is a normal one.
    found["is_anomaly"] = F.coalesce(found["is_anomaly"], F.lit(False))
    return [value.alias(c) for c, value in found.items()]


def _column_bytes(column: Column, kind: T.DataType) -> Column:
    """About what a value takes, without writing it out as text."""
    if isinstance(kind, T.MapType):
        return F.coalesce(F.octet_length(F.array_join(F.map_keys(column), "")) + 12 * F.size(column), F.lit(0))
    return F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) + 4


def _store_size(patterns: DataFrame, carried: list[str]) -> tuple[int | None, int]:
    """Length and bytes of the usable vectors, as a store holds them, with their carried columns, in one scan."""
    kinds = {f.name: f.dataType for f in patterns.schema.fields}
    single = isinstance(kinds["embedding"], T.ArrayType) and isinstance(kinds["embedding"].elementType, T.FloatType)
    others = sum((_column_bytes(F.col(c), kinds[c]) for c in carried), F.lit(0)).cast("bigint")
    sizes = patterns.filter(is_usable("embedding")).groupBy(F.size("embedding").alias("size")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(others).alias("others")
    )
    best = sizes.orderBy(F.desc("count"), "size").first()
    return (best["size"], (4 if single else 8) * best["size"] * best["count"] + best["others"]) if best else (None, 0)


def _shared_store(patterns: DataFrame, key: str | None, meta: bool, max_bytes: int) -> Broadcast | None:
    """The patterns as a broadcast, or None when they are too large for one."""
    columns = [F.col("pattern_id").cast("bigint").alias("pattern_id"), "embedding"]
    if key:
        columns.append(F.col(key).alias("_key"))
    carried = [c for c in HIT_COLUMNS if c in patterns.columns] if meta else [key] if key else []
    dim, size = _store_size(patterns, carried)
    if size > max_bytes:
        return None
    known = usable_vectors(patterns, dim)
    table = known.select(*columns, *(_meta_columns(patterns) if meta else [])).toArrow()
    groups = rows_by_key(table["_key"].to_pylist()) if key else {}
    key_of = np.full(table.num_rows, -2, "int64")
    for number, rows in enumerate(groups.values()):
        key_of[rows] = number
    store = Store(
        table["pattern_id"].to_numpy(), arena_of(matrix(table["embedding"]) if table.num_rows else np.empty((0, dim or 0))),
        {key: number for number, key in enumerate(groups)}, key_of, groups,
        table.select(HIT_COLUMNS).combine_chunks() if meta else table.select([]),
    )
    return patterns.sparkSession.sparkContext.broadcast(store)


def _search_key(
    queries: DataFrame, patterns: DataFrame, k: int, by: str, exclude_self: bool, rows_per_block: int
) -> DataFrame:
    """The best ``k`` patterns with the query's own ``by`` for every query and block, still unranked."""
    dim = store_dim(patterns)
    if dim is None:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    q = stored_vectors(queries.withColumn("query_id", F.col("query_id").cast("bigint")), ["query_id", by], dim)
    p = stored_vectors(patterns.withColumn("pattern_id", F.col("pattern_id").cast("bigint")), ["pattern_id", by], dim)
    q, p = q.filter(F.col(by).isNotNull()), p.filter(F.col(by).isNotNull())

    # Keys meet by buckets: a task gets many small ones at once, and a hot one makes its bucket several blocks.
    buckets = max(1, math.ceil(2 * max(q.count(), p.count()) / rows_per_block))
    q = q.withColumn(by, F.col(by).cast(p.schema[by].dataType))
    q, p = (side.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")) for side in (q, p))
    lefts, rights = ({r["_bucket"]: r["count"] for r in side.groupBy("_bucket").count().collect()} for side in (q, p))
    blocks = [
        (b, max(1, math.ceil(n / rows_per_block)), max(1, math.ceil(rights[b] / rows_per_block)))
        for b, n in lefts.items() if max(n, rights.get(b, 0)) > rows_per_block and b in rights
    ]

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return hit_table([], [], [])
        qid, ids = left["query_id"].to_numpy(), right["pattern_id"].to_numpy()
        groups = rows_by_key(right[by].to_pylist())
        store = Store(ids, matrix(right["embedding"]), {}, np.empty(0, "int64"), groups, right.select([]))
        row, col, far = store.within_key(qid, matrix(left["embedding"]), left[by].to_pylist(), k, exclude_self)
        return hit_table(qid[row], ids[col], far)

    return pair_blocks(q, p, ["_bucket"], "query_id", "pattern_id", search, HIT_SCHEMA, blocks=blocks)


def _search_all(
    queries: DataFrame, patterns: DataFrame, index: CellIndex | None, k: int, exclude_self: bool, rows_per_block: int
) -> DataFrame:
    """The ``k`` nearest of all patterns by their cells; without an index, one is made for this search."""
    if index is None:
        if store_dim(patterns) is None:
            return queries.sparkSession.createDataFrame([], f"{HIT_SCHEMA}, rank int")
        index = build_cells(patterns, rows_per_cell=rows_per_block)
    return search_cells(queries, index, k, exclude_self, rows_per_block).hits


def with_patterns(hits: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add the pattern's own columns to its hits; a much-hit pattern does not skew the join."""
    meta = [c for c in HIT_COLUMNS if c in patterns.columns and c not in hits.columns]
    return dimension_join(hits, patterns.select("pattern_id", *meta), ["pattern_id"])


# --- exact search -----------------------------------------------------------------


def knn(
    queries: DataFrame,
    patterns: DataFrame,
    k: int = 5,
    where: Column | None = None,
    mode: str = "pre",
    metric: str = "l2sq",
    by: str | None = None,
    exclude_self: bool = False,
    max_broadcast_bytes: int = BROADCAST_VECTOR_BYTES,
    rows_per_block: int = 20_000,
    index: CellIndex | None = None,
) -> DataFrame:
    """The ``k`` nearest patterns per query: (query_id, rank, pattern_id, distance).

    A store beyond ``max_broadcast_bytes`` is searched by cells: those of
    ``index`` (``build_cells`` over the same patterns), or of one made here.

    ``where`` (a predicate on the pattern) and ``by`` (a column that query and
    pattern must share) filter before the search; with ``mode="post"`` they
    filter the unrestricted top ``k``. Distances are squared unless
    ``metric="l2"``. Ties go to the lower pattern id.
    """
    if mode not in ("pre", "post"):
        raise ValueError("mode must be pre or post")
    if mode == "post" and (where is not None or by):
        everything = knn(
            queries, patterns, k, metric=metric, exclude_self=exclude_self,
            max_broadcast_bytes=max_broadcast_bytes, rows_per_block=rows_per_block, index=index,
        ).drop("rank")
        kept = with_patterns(everything, patterns)
        if where is not None:
            kept = kept.filter(where)
        if by:
            own = queries.select("query_id", F.col(by).alias("_own"))
            kept = kept.join(own, "query_id").filter(F.col("_own") == F.col(by))
        return best_hits(kept, k).select("query_id", "rank", "pattern_id", "distance")

    if where is not None:
        patterns, index = patterns.filter(where), None
    shared = _shared_store(patterns, by, False, max_broadcast_bytes)
    if shared is None and by:
        ranked = best_hits(_search_key(queries, patterns, k, by, exclude_self, rows_per_block), k)
    elif shared is None:
        ranked = _search_all(queries, patterns, index, k, exclude_self, rows_per_block)
    else:
        ranked = _knn_shared(queries, shared, k, by, exclude_self)
    if metric == "l2":
        ranked = ranked.withColumn("distance", F.sqrt("distance"))
    return ranked.select("query_id", "rank", "pattern_id", "distance")


def _knn_shared(queries: DataFrame, shared: Broadcast, k: int, by: str | None, exclude_self: bool) -> DataFrame:
    """Every task ranks its own queries completely, so nothing is shuffled."""
    keys = [by] if by else []

    def search(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store = shared.value
        for batch in batches:
            # Checked here: a filter would repeat the expression that makes the embedding.
            known, q = usable_rows(batch.column("embedding"), store.vectors.size)
            batch = batch.take(pa.array(known.astype(np.int64)))
            qid = batch.column("query_id").to_numpy(zero_copy_only=False)
            if by:
                row, col, far = store.within_key(qid, q, batch.column(by).to_pylist(), k, exclude_self)
                order = np.argsort(row, kind="stable")
                row, col, far = row[order], col[order], far[order]
            else:
                row, col, far = store.everywhere(qid, q, np.arange(len(qid)), k, exclude_self)
            table = hit_table(qid[row], store.ids[col], far)
            yield from table.append_column("rank", pa.array(ranks(row), pa.int32())).to_batches()

    q = queries.select(F.col("query_id").cast("bigint"), *keys, F.col("embedding").cast("array<double>").alias("embedding"))
    return q.mapInArrow(search, HIT_SCHEMA + ", rank int")


def knn_same_host(queries: DataFrame, patterns: DataFrame, k: int = 5, **options) -> DataFrame:
    return knn(queries, patterns, k, by="host_id", **options)


def knn_same_activity(queries: DataFrame, patterns: DataFrame, k: int = 5, **options) -> DataFrame:
    return knn(queries, patterns, k, by="activity", **options)


def knn_anomalies(queries: DataFrame, patterns: DataFrame, k: int = 5, **options) -> DataFrame:
    return knn(queries, patterns, k, where=F.col("is_anomaly"), **options)


# --- host-first retrieval -----------------------------------------------------------


def retrieve(
    queries: DataFrame,
    patterns: DataFrame,
    k: int = 5,
    mode: str = "pre",
    exclude_self: bool = False,
    max_broadcast_bytes: int = BROADCAST_VECTOR_BYTES,
    rows_per_block: int = 20_000,
    index: CellIndex | IvfPqIndex | None = None,
    nprobe: int = 10,
) -> DataFrame:
    """The queries with a column ``hits``: what ``retrieve_rows`` gives, as an array by rank.

    The kind of the store's ``index`` decides how a store beyond
    ``max_broadcast_bytes`` is searched: by cells, exactly, or by codes of the
    ``nprobe`` nearest cells (with ``host_id`` carried), approximately.

    With a small pattern table this is one pass over the queries without a
    shuffle. Pass a stored pattern table: it is read more than once.
    """
    shared = _shared_store(patterns, "host_id", True, max_broadcast_bytes)
    if shared is None:
        slim = cut(queries.select("query_id", "host_id", "embedding"))  # read several times
        return attach_hits(
            queries, _host_first_blocks(slim, patterns, k, mode, exclude_self, rows_per_block, index, nprobe)
        )
    return _host_first_shared(queries, shared, k, mode, exclude_self)


def retrieve_rows(queries: DataFrame, patterns: DataFrame, k: int = 5, **options) -> DataFrame:
    """Hits of the query's own host first; below ``k // 2`` of them other hosts fill up.

    The fill comes from the unrestricted top ``k``. A query without a host gets
    that top ``k`` as it is. With ``mode="post"`` the host's hits are those
    among the unrestricted top ``k``. One row per hit.
    """
    return retrieve(queries, patterns, k, **options).select("query_id", F.inline("hits"))


def _host_first_shared(
    queries: DataFrame, shared: Broadcast, k: int, mode: str, exclude_self: bool
) -> DataFrame:
    names = [c for c in queries.columns if c != "hits"]
    rows = queries.select(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", T.ArrayType(_hit_type()))])
    dim_type = pa.list_(pa.float64())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store = shared.value
        for batch in batches:
            n = batch.num_rows
            column = batch.column("embedding")
            ids = batch.column("query_id").to_numpy(zero_copy_only=False)
            known, q = usable_rows(column.cast(dim_type), store.vectors.size)
            keys = batch.column("host_id").take(pa.array(known)).to_pylist()
            row, col, far = store.host_first(ids[known], q, keys, k, exclude_self, mode == "post")
            row = known[row] if len(row) else row
            taken = store.meta.take(pa.array(col, pa.int64())).combine_chunks()
            hit = pa.StructArray.from_arrays(
                [
                    pa.array(ranks(row), pa.int32()), pa.array(store.ids[col], pa.int64()), pa.array(far),
                    *[_plain(taken[c]) for c in HIT_COLUMNS],
                ],
                names=["rank", "pattern_id", "distance", *HIT_COLUMNS],
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*names, "hits"])

    return rows.mapInArrow(search, schema)


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _hit_type() -> T.StructType:
    text = T.StringType()
    return T.StructType(
        [
            T.StructField("rank", T.IntegerType()),
            T.StructField("pattern_id", T.LongType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("host_id", text),
            T.StructField("activity", text),
            T.StructField("ts", text),
            T.StructField("is_anomaly", T.BooleanType()),
            T.StructField("anomaly_type", text),
            T.StructField("description", text),
            T.StructField("explanation", text),
            T.StructField("readings", T.MapType(text, T.DoubleType())),
        ]
    )


def _host_first_blocks(
    queries: DataFrame, patterns: DataFrame, k: int, mode: str, exclude_self: bool, rows_per_block: int,
    index: CellIndex | IvfPqIndex | None, nprobe: int,
) -> DataFrame:
    """Host-first retrieval from a large store, one row per hit.

    The general search goes by cells and only runs for queries that need it: how many own hits
    there will be follows from the patterns per host.
    """
    own = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("host_id").alias("_own"))
    need = k // 2
    coded = isinstance(index, IvfPqIndex)

    def general(some: DataFrame) -> DataFrame:
        if coded:
            return ivfpq_search(some, index, k, nprobe, exclude_self=exclude_self, rows_per_block=rows_per_block)
        return _search_all(some, patterns, index, k, exclude_self, rows_per_block)

    if mode == "post":
        near = cut(general(queries).drop("rank"))
        marked = with_patterns(near, patterns).join(own, "query_id").withColumn(
            "_general", F.coalesce(F.col("host_id") != F.col("_own"), F.lit(True))
        )
        hosts = F.count_if(~F.col("_general")).over(Window.partitionBy("query_id"))
        fill = F.col("_own").isNull() | (hosts < need)
        kept = marked.withColumn("_fill", fill).filter(~F.col("_general") | F.col("_fill"))
    else:
        per_host = usable_vectors(patterns, store_dim(patterns)).groupBy("host_id").agg(
            F.count(F.lit(1)).alias("_patterns")
        )
        counted = dimension_join(queries.select("query_id", "host_id", "embedding"), per_host, ["host_id"])
        if exclude_self:
            itself = patterns.select(F.col("pattern_id").alias("query_id"), "host_id", F.lit(1).alias("_itself"))
            counted = counted.join(itself, ["query_id", "host_id"], "left").withColumn(
                "_patterns", F.col("_patterns") - F.coalesce("_itself", F.lit(0))
            )
        short = F.coalesce(F.col("_patterns"), F.lit(0)) < need
        lacking = counted.filter(short | F.col("host_id").isNull()).select("query_id", "host_id", "embedding")
        if coded:
            first = ivfpq_search(
                queries, index, k, nprobe, by="host_id", exclude_self=exclude_self, rows_per_block=rows_per_block
            ).drop("rank")
        else:
            first = _search_key(queries, patterns, k, "host_id", exclude_self, rows_per_block)
        fill = general(lacking).drop("rank")
        both = first.withColumn("_general", F.lit(False)).unionByName(fill.withColumn("_general", F.lit(True)))
        # Found hits are slim and dear to find: keep them before they meet the patterns again.
        best = cut(best_hits(both, k, ["query_id", "_general"]).drop("rank"))
        kept = with_patterns(best, patterns).join(own, "query_id").filter(
            ~F.col("_general") | F.col("_own").isNull() | (F.col("host_id") != F.col("_own"))
        )
    order = Window.partitionBy("query_id").orderBy("_general", "distance", "pattern_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "pattern_id", "distance", *_meta_columns(ranked))


def attach_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per hit gathered into a ``hits`` array per query; a query has few hits."""
    if "hits" in queries.columns:
        return queries
    rank = F.col("rank") if "rank" in hits.columns else F.lit(0)
    hit = F.struct(rank.cast("int").alias("rank"), "pattern_id", "distance", *_meta_columns(hits))
    # Hits hold maps, which have no order: their places are sorted.
    order = F.array_sort(
        F.transform("_hits", lambda h, place: F.struct(h["rank"], h["distance"], h["pattern_id"], place.alias("place")))
    )
    nested = hits.groupBy("query_id").agg(F.collect_list(hit).alias("_hits")).select(
        "query_id", F.transform(order, lambda o: F.get("_hits", o["place"])).alias("hits")
    )
    joined = queries.join(nested, "query_id", "left")
    empty = F.array().cast(nested.schema["hits"].dataType)
    return joined.withColumn("hits", F.coalesce("hits", empty))


def top_hits(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "pattern_id")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


# --- quality ------------------------------------------------------------------------------


def knn_accuracy(
    df: DataFrame, k: int = 3, test: float = 0.3, seed: int = 42, row_id: str = "row_id", label: str = "label"
) -> DataFrame:
    """Hold out rows by a seeded hash, let their ``k`` nearest neighbours vote, count hits.

    A tied vote goes to the lower label.
    """
    part = F.pmod(shuffled_number(row_id, seed), F.lit(1000)) < int(test * 1000)
    rows = df.select(F.col(row_id).cast("bigint").alias("query_id"), "embedding", label, part.alias("_test"))
    held = rows.filter("_test")
    known = rows.filter(~F.col("_test")).withColumnRenamed("query_id", "pattern_id")
    hits = dimension_join(knn(held, known, k), known.select("pattern_id", label), ["pattern_id"])
    votes = hits.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("_votes"))
    chosen = votes.groupBy("query_id").agg(
        F.min_by(F.col(label), F.struct(-F.col("_votes"), F.col(label))).alias("predicted")
    )
    truth = held.select("query_id", F.col(label).alias("_truth"))
    return truth.join(chosen, "query_id", "left").agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(F.col("_truth") == F.col("predicted")).alias("correct"),
        F.try_divide(F.count_if(F.col("_truth") == F.col("predicted")), F.count(F.lit(1))).alias("accuracy"),
    )
