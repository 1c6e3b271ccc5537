"""Queries over the pattern table and retrieval, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewatch.functions.columns import seconds_since
from gaugewatch.operators import cells, clean, features, ivfpq, patterns, profiling, retrieval, sampling
from gaugewatch.operators.scale import spread
from gaugewatch.plans import tables as t
from gaugewatch.plans.profiles import HELD
from gaugewatch.plans.tables import r
from gaugewatch.session import cut, fresh_path
from gaugewatch.sources import store

K = 5
# Wide readings have five decimals, so their squares have ten: no rounding ties.
WIDE_DIGITS = 10

# --- the pattern table -----------------------------------------------------------------


def wide_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows as samples with readings and tiled embedding."""
    rows = clean.sparse_samples(features.wide_features(spread(t.wide(spark, sf_dir))), t.WIDE_SENSORS)
    return features.with_embedding(rows, t.WIDE_DIM).select(
        F.col("uuid").alias("query_id"), F.col("hostID").alias("host_id"), "activity",
        F.col("timestamp").alias("ts"), "status", "readings", "embedding",
    )


def wide_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as patterns; urgent ones are known anomalies."""
    done = wide_samples(spark, sf_dir).filter(F.col("status") == "F").withColumnRenamed("query_id", "pattern_id")
    urgent = F.col("activity") == "1-URGENT"
    told = F.concat(F.lit("Urgent order of "), F.col("host_id"))
    return patterns.labelled_patterns(done, urgent, "behavioral", told).drop("status")


def normal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_samples(spark, sf_dir)
    note = F.when(F.col("status") != "P", F.concat(F.lit("Normal pattern for "), F.col("host_id")))
    made = patterns.normal_patterns(rows, note)
    return t.tidy(
        made.select(
            "query_id", "host_id", "activity", "ts", "is_anomaly", "description",
            F.get("embedding", F.lit(15)).alias("last_value"),
        )
    )


NORMAL_PATTERNS = f"""WITH {t.WIDE_EMBEDDED}
SELECT uuid AS query_id, hostID AS host_id, activity, timestamp AS ts, false AS is_anomaly,
       CASE WHEN status <> 'P' THEN 'Normal pattern for ' || hostID ELSE 'Normal sensor pattern' END AS description,
       {r('embedding[16]')} AS last_value FROM embedded"""


def anomaly_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = patterns.anomaly_patterns(
        wide_samples(spark, sf_dir), F.col("activity"), F.concat(F.lit("Seen at "), F.col("ts"))
    )
    return made.select("query_id", "is_anomaly", "anomaly_type", "explanation", F.size("readings").cast("bigint").alias("n"))


ANOMALY_PATTERNS = f"""WITH {t.WIDE_EMBEDDED}
SELECT uuid AS query_id, true AS is_anomaly, activity AS anomaly_type, 'Seen at ' || timestamp AS explanation,
       len(features) AS n FROM embedded"""


def add_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide samples, with their whole vectors, go behind the readings in one store; written and read again."""
    path = fresh_path(spark, "patterns")
    store.save_patterns(city_patterns(spark, sf_dir, t.WIDE_DIM), path)
    saved = store.load_patterns(spark, path)
    new = patterns.normal_patterns(wide_samples(spark, sf_dir))
    more = patterns.add_patterns(saved, new, t.WIDE_DIM, "query_id")
    store.save_patterns(more.select(saved.columns), path)
    both = store.load_patterns(spark, path)
    return both.groupBy("is_anomaly").agg(
        F.count(F.lit(1)).alias("n"), F.min("pattern_id").alias("first_id"), F.max("pattern_id").alias("last_id"),
        F.sum(F.size("embedding")).alias("n_values"),
    )


CITY_DIM = 6


def city_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable readings as samples: seconds of the year and values, tiled."""
    usable = clean.reject_unparsed(spread(t.readings(spark, sf_dir)), "value_hrf")
    timed = usable.withColumn("unix_time", seconds_since("timestamp", None))
    vectors = features.reading_features(timed, column="value_hrf")
    return features.with_embedding(vectors, CITY_DIM).select(
        F.col("ingest_id").alias("query_id"), F.col("node_id").alias("host_id"),
        F.col("parameter").alias("activity"), F.col("timestamp").alias("ts"),
        F.create_map(F.lit("value"), F.get("values", F.lit(0))).alias("readings"), "embedding",
    )


def city_patterns(spark: SparkSession, sf_dir: str, dim: int = CITY_DIM) -> DataFrame:
    """The first nine tenths of every node as normal patterns, the rest scaled as anomalies."""
    usable = clean.reject_unparsed(t.readings(spark, sf_dir), "value_hrf")
    held = sampling.inject_anomalies(sampling.split_holdout(usable))
    year = seconds_since("timestamp", None).cast("double")
    vectors = held.withColumn("features", F.concat(F.array(year), F.col("values")))
    rows = features.with_embedding(vectors, dim).select(
        F.col("ingest_id").alias("pattern_id"), F.col("node_id").alias("host_id"),
        F.col("parameter").alias("activity"), F.col("timestamp").alias("ts"), "is_holdout", "embedding",
        F.create_map(F.lit("value"), F.get("values", F.lit(0))).alias("readings"),
    )

    def told(what: str) -> Column:
        return F.concat(F.lit(f"{what} for node "), F.col("host_id"), F.lit(" with "), F.col("activity"))

    return patterns.labelled_patterns(
        rows, F.col("is_holdout"), "sensor reading", told("Simulated anomaly"), told("Normal pattern")
    ).drop("is_holdout")


ADD_PATTERNS = f"""WITH {HELD}, ids AS (
  SELECT holdout_position IS NOT NULL AS is_anomaly, ingest_id AS id FROM held
  UNION ALL
  SELECT false, (SELECT max(ingest_id) FROM held) + row_number() OVER (ORDER BY l_orderkey)
  FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
SELECT is_anomaly, count(*) AS n, min(id) AS first_id, max(id) AS last_id,
       count(*) * {t.WIDE_DIM} AS n_values FROM ids GROUP BY 1"""


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.load_counts(city_patterns(spark, sf_dir))


LOAD_COUNTS = f"""WITH {HELD}
SELECT node_id AS host_id, count(*) AS samples, count(*) FILTER (holdout_position IS NULL) AS patterns,
       count(*) FILTER (holdout_position IS NOT NULL) AS anomalies FROM held GROUP BY 1"""


def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(patterns.pattern_stats(t.vector_patterns(spark, sf_dir)))


PATTERN_STATS = """SELECT count(*) AS total_vectors, max(len(embedding)) AS dimension, 'flat' AS index_type,
       count(*) AS metadata_count, true AS is_trained FROM embeddings"""

# --- searches -----------------------------------------------------------------------------


def _search(run) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = run(t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir))
        return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance"))

    return query


def _search_sql(where: str = "true", distance: str = "distance") -> str:
    return f"""WITH {t.PAIRS}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank, pattern_id,
       {r(distance)} AS distance
FROM pairs WHERE {where}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= {K}"""


def _post_sql(where: str) -> str:
    return f"""WITH {t.TOP5}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank, pattern_id,
       {r('distance')} AS distance FROM hits WHERE {where}"""


knn = _search(lambda q, p: retrieval.knn(q, p, K, exclude_self=True))
knn_blocks = _search(
    lambda q, p: retrieval.knn(q, p, K, exclude_self=True, max_broadcast_bytes=0, rows_per_block=300)
)
knn_l2 = _search(lambda q, p: retrieval.knn(q, p, K, exclude_self=True, metric="l2"))
knn_post = _search(lambda q, p: retrieval.knn(q, p, K, F.col("is_anomaly"), "post", exclude_self=True))
knn_anomalies = _search(lambda q, p: retrieval.knn_anomalies(q, p, K, exclude_self=True))
knn_same_activity = _search(lambda q, p: retrieval.knn_same_activity(q, p, K, exclude_self=True))
knn_same_host = _search(lambda q, p: retrieval.knn_same_host(q, p, K, exclude_self=True))


def _dirty(df: DataFrame, row_id: str) -> DataFrame:
    """Some vectors with NaN, some NULL, some too short."""
    seventh, v = F.pmod(row_id, F.lit(7)), F.col("embedding")
    nan = F.concat(F.slice(v, 1, 5), F.array(F.lit(float("nan")).cast("float")), F.slice(v, 7, 100))
    return df.withColumn(
        "embedding", F.when(seventh == 1, nan).when(seventh == 3, F.slice(v, 1, 9)).when(seventh != 2, v)
    )


CLEAN_VECTORS = "FROM embeddings WHERE vec_id % 7 NOT IN (1, 2, 3)"


def _search_dirty(**options) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, p = _dirty(t.vector_queries(spark, sf_dir), "query_id"), _dirty(t.vector_patterns(spark, sf_dir), "pattern_id")
        return t.tidy(retrieval.knn(q, p, K, exclude_self=True, **options).select("query_id", "rank", "pattern_id", "distance"))

    return query


def _retrieve_dirty(**options) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, p = _dirty(t.vector_queries(spark, sf_dir), "query_id"), _dirty(t.vector_patterns(spark, sf_dir), "pattern_id")
        hits = retrieval.retrieve_rows(q, p, K, exclude_self=True, **options)
        return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance", "host_id", "is_anomaly"))

    return query


BLOCKS = {"max_broadcast_bytes": 0, "rows_per_block": 300}
knn_dirty, knn_dirty_blocks = _search_dirty(), _search_dirty(**BLOCKS)
retrieve_dirty, retrieve_dirty_blocks = _retrieve_dirty(), _retrieve_dirty(**BLOCKS)


def knn_wide_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders against the finished ones of the same customer."""
    open_orders = wide_samples(spark, sf_dir).filter(F.col("status") != "F")
    known = cut(wide_patterns(spark, sf_dir))
    return t.tidy(retrieval.knn_same_host(open_orders, known, K), WIDE_DIGITS)


_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
KNN_WIDE_HOST = f"""WITH {t.WIDE_EMBEDDED}, pairs AS (
  SELECT q.uuid AS query_id, p.uuid AS pattern_id, {_SQ.format(a='q.embedding', b='p.embedding')} AS distance
  FROM embedded q JOIN embedded p ON q.hostID = p.hostID WHERE q.status <> 'F' AND p.status = 'F')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank, pattern_id,
       {r('distance', WIDE_DIGITS)} AS distance
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= {K}"""


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.retrieve_rows(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, exclude_self=True
    )
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance", "host_id", "is_anomaly"))


def retrieve_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``retrieve`` for a store that is too large to be everywhere."""
    hits = retrieval.retrieve_rows(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K,
        exclude_self=True, max_broadcast_bytes=0, rows_per_block=300,
    )
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance", "host_id", "is_anomaly"))


def _cells(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    """An index over the vectors of even id, with the odd ones added to it afterwards."""
    known = t.vector_patterns(spark, sf_dir)
    even = F.pmod("pattern_id", F.lit(2)) == 0
    index = cells.build_cells(known.filter(even), rows_per_cell=40, carry=["host_id"])
    return cells.add_to_cells(cells.load_cells(spark, index.path), known.filter(~even))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``knn`` from a stored index that was added to."""
    hits = retrieval.knn(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, exclude_self=True,
        max_broadcast_bytes=0, index=_cells(spark, sf_dir),
    )
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance"))


def knn_cells_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings of finished orders a search for the open ones' neighbours compares, by round; all hits exact."""
    wide = cut(wide_samples(spark, sf_dir))
    known = wide.filter(F.col("status") == "F").withColumnRenamed("query_id", "pattern_id")
    index = cells.build_cells(known, rows_per_cell=max(50, known.count() // 16))
    found = cells.search_cells(wide.filter(F.col("status") != "F"), index, K)
    share = found.report.agg(F.sum("compared").alias("compared"), F.max("possible").alias("possible")).first()
    hits = found.hits.withColumn("pruned", F.lit(share["compared"] < share["possible"]))
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance", "pruned"), WIDE_DIGITS)


KNN_CELLS_REPORT = f"""WITH {t.WIDE_EMBEDDED}, pairs AS (
  SELECT q.uuid AS query_id, p.uuid AS pattern_id, {_SQ.format(a='q.embedding', b='p.embedding')} AS distance
  FROM embedded q, embedded p WHERE q.status <> 'F' AND p.status = 'F')
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank, pattern_id,
       {r('distance', WIDE_DIGITS)} AS distance, true AS pruned
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= {K}"""


def retrieve_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-first retrieval whose fill-up goes by the cells of a stored index."""
    hits = retrieval.retrieve_rows(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, exclude_self=True,
        max_broadcast_bytes=0, index=_cells(spark, sf_dir),
    )
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance", "host_id", "is_anomaly"))


RETRIEVE = f"""WITH {t.HOST_FIRST}
SELECT query_id, rank, pattern_id, {r('distance')} AS distance, host_id, is_anomaly FROM hits"""


def retrieve_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.retrieve_rows(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, mode="post", exclude_self=True
    )
    return t.tidy(hits.select("query_id", "rank", "pattern_id", "distance"))


RETRIEVE_POST = f"""WITH {t.TOP5}, marked AS (
  SELECT *, host_id <> own_host AS general,
         count(*) FILTER (host_id = own_host) OVER (PARTITION BY query_id) AS own_hits FROM hits)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY general, distance, pattern_id) AS rank, pattern_id,
       {r('distance')} AS distance FROM marked WHERE NOT general OR own_hits < 2"""


def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.retrieve_rows(
        t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir), K, exclude_self=True
    )
    return t.tidy(retrieval.top_hits(hits, 3).select("query_id", "place", "pattern_id", "activity"))


TOP_HITS = f"""WITH {t.HOST_FIRST}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS place, pattern_id, activity
FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= 3"""


# The model by id: the first vectors are centres, the next ones' remainders fill the codebooks.
NLIST, PARTS, ENTRIES, NPROBE = 8, 4, 16, 3


def _ivfpq_model(spark: SparkSession, sf_dir: str) -> ivfpq.IvfPqModel:
    """NLIST + ENTRIES vectors reach the driver, whatever the table's size."""
    known = t.read(spark, sf_dir, "embeddings").filter(F.col("vec_id") < NLIST + ENTRIES).orderBy("vec_id")
    vectors = np.array([row["embedding"] for row in known.select("embedding").collect()], np.float64)
    centres, others = vectors[:NLIST], vectors[NLIST:]
    rests = others - centres[((others[:, None] - centres[None]) ** 2).sum(2).argmin(1)]
    return ivfpq.ivfpq_model(centres, rests.reshape(ENTRIES, PARTS, -1).transpose(1, 0, 2))


CARRIED = ["host_id", "is_anomaly"]


def _ivfpq_search(added: bool = False, **options) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        known, model = t.vector_patterns(spark, sf_dir), _ivfpq_model(spark, sf_dir)
        if added:
            even = F.pmod("pattern_id", F.lit(2)) == 0
            path = ivfpq.ivfpq_create(known.filter(even), model, carry=CARRIED).path
            index = ivfpq.ivfpq_add(ivfpq.ivfpq_load(spark, path, model.version), known.filter(~even))
        else:
            index = ivfpq.ivfpq_create(known, model, carry=CARRIED)
        return t.tidy(ivfpq.ivfpq_search(t.vector_queries(spark, sf_dir), index, K, NPROBE, exclude_self=True, **options))

    return query


ivfpq_search, ivfpq_added = _ivfpq_search(), _ivfpq_search(added=True)
ivfpq_same_host = _ivfpq_search(by="host_id")
ivfpq_anomalies = _ivfpq_search(added=True, where="is_anomaly")


IVFPQ_PARTS = f"""plain AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM vectors),
rests AS MATERIALIZED (
  SELECT e.vec_id, c.vec_id AS cell, list_transform(list_zip(e.v, c.v), lambda z: z[1] - z[2]) AS rest,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY {_SQ.format(a='e.v', b='c.v')}, c.vec_id) AS place
  FROM plain e, plain c WHERE c.vec_id < {NLIST}),
books AS MATERIALIZED (
  SELECT j, vec_id - {NLIST} AS entry, rest[j * <size> + 1 : (j + 1) * <size>] AS entry_rest
  FROM rests, range({PARTS}) AS parts(j) WHERE place = 1 AND vec_id BETWEEN {NLIST} AND {NLIST + ENTRIES - 1}),
codes AS MATERIALIZED (
  SELECT vec_id, cell, j, entry FROM (
    SELECT vec_id, cell, j, entry, row_number() OVER (
      PARTITION BY vec_id, j ORDER BY {_SQ.format(a='rest[j * <size> + 1 : (j + 1) * <size>]', b='entry_rest')}, entry) AS place
    FROM (SELECT vec_id, cell, rest FROM rests WHERE place = 1), books) WHERE place = 1)"""


def _ivfpq_sql(match: str = "true", key: str = "0", where: str = "true") -> str:
    """Cells by distance, codes of remainders, and sums of distances to the codes' entries; filters by counts per cell."""
    size = f"(len(rest) // {PARTS})"
    return f"""WITH {t.VECTORS}, {IVFPQ_PARTS.replace('<size>', size)},
counts AS (SELECT cell, {key} AS key, count(*) AS n FROM codes JOIN vectors USING (vec_id) WHERE j = 0 AND {where} GROUP BY ALL),
cells AS (
  SELECT vec_id, cell, place, coalesce(n, 0) AS n,
         coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT vec_id, cell, place, {key} AS key FROM rests JOIN vectors USING (vec_id)) LEFT JOIN counts USING (cell, key)),
probes AS (SELECT vec_id, cell FROM cells WHERE n > 0 AND (place <= {NPROBE} OR before < {K + 1})),
tables AS (
  SELECT r.vec_id, r.cell, b.j, b.entry, {_SQ.format(a=f'r.rest[b.j * {size} + 1 : (b.j + 1) * {size}]', b='b.entry_rest')} AS far
  FROM probes JOIN rests r USING (vec_id, cell), books b),
found AS (
  SELECT p.vec_id AS query_id, c.vec_id AS pattern_id, sum(far ORDER BY s.j) AS distance
  FROM probes p JOIN codes c USING (cell) JOIN vectors q ON q.vec_id = p.vec_id JOIN vectors v ON v.vec_id = c.vec_id
  JOIN tables s ON s.vec_id = p.vec_id AND s.cell = c.cell AND s.j = c.j AND s.entry = c.entry
  WHERE p.vec_id <> c.vec_id AND {match} GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) AS rank, pattern_id,
       {r('distance')} AS distance
FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= {K}"""


def ivfpq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained index with exact ranks of its candidates, against the exact search."""
    q, p = t.vector_queries(spark, sf_dir), t.vector_patterns(spark, sf_dir)
    index = ivfpq.ivfpq_create(p, ivfpq.ivfpq_train(p, nlist=8, m=16, bits=5, rounds=5))
    found = ivfpq.ivfpq_search(q, index, K, nprobe=7, exclude_self=True, refine=12, patterns=p)
    told = ivfpq.ivfpq_recall(found, retrieval.knn(q, p, K, exclude_self=True))
    return told.select("hits", (F.col("recall") >= 0.9).alias("enough"))


IVFPQ_RECALL = f"SELECT count(*) * least({K}, count(*) - 1) AS hits, true AS enough FROM embeddings"


def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.tidy(retrieval.knn_accuracy(t.read(spark, sf_dir, "embeddings"), row_id="vec_id"))


KNN_ACCURACY = f"""WITH parts AS (
  SELECT *, ('0x' || substr(md5('42:' || vec_id::varchar), 1, 15))::bigint % 1000 < 300 AS test FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, a.label AS truth, b.label,
         list_sum(list_transform(list_zip(a.embedding, b.embedding),
                  lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS distance
  FROM parts a JOIN parts b ON a.test AND NOT b.test),
near AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pattern_id) <= 3),
votes AS (SELECT query_id, truth, label, count(*) AS n FROM near GROUP BY ALL),
chosen AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1)
SELECT count(*) AS tested, count(*) FILTER (truth = label) AS correct,
       {r('count(*) FILTER (truth = label) / count(*)')} AS accuracy FROM chosen"""

KNN_DIRTY = _search_sql().replace("FROM embeddings", CLEAN_VECTORS)
RETRIEVE_DIRTY = RETRIEVE.replace("FROM embeddings", CLEAN_VECTORS)

QUERIES = {
    "knn_dirty": (knn_dirty, KNN_DIRTY),
    "knn_dirty_blocks": (knn_dirty_blocks, KNN_DIRTY),
    "retrieve_dirty": (retrieve_dirty, RETRIEVE_DIRTY),
    "retrieve_dirty_blocks": (retrieve_dirty_blocks, RETRIEVE_DIRTY),
    "normal_patterns": (normal_patterns, NORMAL_PATTERNS),
    "anomaly_patterns": (anomaly_patterns, ANOMALY_PATTERNS),
    "add_patterns": (add_patterns, ADD_PATTERNS),
    "load_counts": (load_counts, LOAD_COUNTS),
    "pattern_stats": (pattern_stats, PATTERN_STATS),
    "knn": (knn, _search_sql()),
    "knn_blocks": (knn_blocks, _search_sql()),
    "knn_l2": (knn_l2, _search_sql(distance="sqrt(distance)")),
    "knn_post": (knn_post, _post_sql("is_anomaly")),
    "knn_anomalies": (knn_anomalies, _search_sql("is_anomaly")),
    "knn_same_activity": (knn_same_activity, _search_sql("activity = own_activity")),
    "knn_same_host": (knn_same_host, _search_sql("host_id = own_host")),
    "knn_wide_host": (knn_wide_host, KNN_WIDE_HOST),
    "knn_cells": (knn_cells, _search_sql()),
    "knn_cells_report": (knn_cells_report, KNN_CELLS_REPORT),
    "retrieve": (retrieve, RETRIEVE),
    "retrieve_cells": (retrieve_cells, RETRIEVE),
    "retrieve_blocks": (retrieve_blocks, RETRIEVE),
    "retrieve_post": (retrieve_post, RETRIEVE_POST),
    "top_hits": (top_hits, TOP_HITS),
    "ivfpq_search": (ivfpq_search, _ivfpq_sql()),
    "ivfpq_added": (ivfpq_added, _ivfpq_sql()),
    "ivfpq_same_host": (ivfpq_same_host, _ivfpq_sql("q.host_id = v.host_id", "host_id")),
    "ivfpq_anomalies": (ivfpq_anomalies, _ivfpq_sql("v.is_anomaly", where="is_anomaly")),
    "ivfpq_recall": (ivfpq_recall, IVFPQ_RECALL),
    "knn_accuracy": (knn_accuracy, KNN_ACCURACY),
}
