"""Exact join of documents whose word shingles overlap by Jaccard 0.8 or more.

Jaccard distance is a metric: members of a region have known distances to its
pivot, and two that differ in them by more than 0.2 cannot link. Between
unrelated texts all distances are 1, where the triangle inequality cannot tell
anything apart, so regions are formed by shared shingles:

1. Blocks of documents send their distinct sets' shingles, in 6 bytes, to
   buckets, which answer with one bit: does another set have this shingle? A
   set that shares less than 80 % of its shingles with all others together
   links with none. Of the others, ordered by hash with the most frequent ones
   (a fixed number, counted before) last, two that link share one of the first
   ``shared - ceil(0.8 n) + 1`` shared shingles: their keys.
2. The set with the smallest hash that has a key is the key's pivot. A pivot's
   region holds every set that shares such a key with it, once, so each pair
   that links meets in a region.
3. A region of bounded size is joined in one task. A larger one is compared
   with its pivot first and cut into rings by distance, and rings into blocks;
   only blocks whose rings are within 0.2 of each other meet, and documents
   are replicated to those meetings only.
4. A meeting counts intersections exactly and returns a spanning forest of the
   links it finds, never all of its pairs. The forests of all meetings form
   the components (alternating large and small stars).

Sets are kept as sorted 64-bit hashes; documents with equal sets are one.

A document has the smallest id that it reaches by links as component; rows
without an id never give one, and have none if all of their component lack
it. Null and empty texts have no set and link with nothing. Repeated rows
give repeated results, an empty table an empty one. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.llm.common import as_bytes, batches, free_names, least_parts, parts_for, total_bytes
from gaugewatch.llm.shingles import mix, shingle_sets
from gaugewatch.session import fresh_path

PERCENT = 80
FREQUENT = 65_536
CHUNK = 1 << 20
BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
REGION = 1000
RINGS = 20
DENSE = 32
COLUMNS = 4096
GROUP_BYTES = 8 << 20

SKETCH = "block_ long, bucket_ long, keys_ binary, counts_ binary"
ANSWER = "block_ long, bucket_ long, bits_ binary"
SETS = "doc_id long, text_hash long, n_shingles long, sig long, keys array<long>, shingles binary"


def frequent_shingles(docs: DataFrame, at_most: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, ascending; which ones they are decides speed, never results."""

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, CHUNK):
            values, _ = shingle_sets(as_bytes(batch.column("text")))
            found, count = np.unique(values, return_counts=True)
            some = count >= 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[some].view(np.int64)), pa.array(count[some].astype(np.int64))], ["h", "n"]
            )

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, n long")
    rows = counted.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(at_most).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


class Block:
    """Distinct sets of one block of documents, their keys in the common order."""

    def __init__(self, docs: pa.Table, frequent: np.ndarray):
        self.ids = docs.column("doc_id").to_pylist()
        texts = as_bytes(docs.column("text"))
        parts, at = [], 0
        while at < len(texts) or not parts:
            size, end = 0, at
            while end < len(texts) and (size < CHUNK or end == at):
                size += len(texts[end])
                end += 1
            parts.append(shingle_sets(texts[at:end]))
            at = end
        self.values = np.concatenate([v for v, _ in parts])
        sizes = np.concatenate([np.diff(o) for _, o in parts])
        self.n = sizes
        self.offsets = np.r_[0, np.cumsum(sizes)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = np.zeros(len(sizes), np.uint64)
        np.add.at(total, doc, mix(self.values + np.uint64(7)))
        self.sig = mix(total + sizes.astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(sizes)
        # One document stands for all with the same set.
        self.classes = some[np.unique(self.sig[some], return_index=True)[1]] if len(some) else some
        late = np.zeros(len(self.values), np.uint64)
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, self.values), len(frequent) - 1)
            late = (frequent[place] == self.values).astype(np.uint64)
        chosen = np.zeros(len(sizes), bool)
        chosen[self.classes] = True
        pick = chosen[doc]
        # The common order of shingles: frequent ones last, else by key.
        self.key, self.owner = mix(self.values[pick] + np.uint64(3)) >> np.uint64(16), doc[pick]
        self.place = (late[pick] << np.uint64(48)) | self.key
        self.entry_key, self.entry, count = np.unique(self.key, return_inverse=True, return_counts=True)
        self.entry_many = count > 1

    def region_keys(self, shared: np.ndarray) -> dict[int, list[int]]:
        """Keys of each set that can link, from one bit per distinct key of the block."""
        hits = shared[self.entry]
        owner, place, key = self.owner[hits], self.place[hits], self.key[hits].astype(np.int64)
        order = np.lexsort((place, owner))
        owner, key = owner[order], key[order]
        count = np.bincount(owner, minlength=len(self.n))
        more = count - (PERCENT * self.n + 99) // 100 + 1
        rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        keep = rank < more[owner]
        owner, key = owner[keep], key[keep]
        return {d: key[a:e].tolist() for d, a, e in _slices(owner)}


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(bucket):
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), int(a), int(b)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def _sketch(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        number = docs.column("block_")[0].as_py()
        block = Block(docs, np.zeros(0, np.uint64))
        rows = []
        for b, a, e in _slices(_bucket(block.entry_key, buckets)):
            keys = block.entry_key[a:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
            rows.append((number, b, keys, np.packbits(block.entry_many[a:e]).tobytes()))
        return _table(rows, SKETCH)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """For each key of each block: does another set have it?"""
    blocks, bucket = rows.column("block_").to_pylist(), rows.column("bucket_")[0].as_py()
    keys, many = [], []
    for raw, bits in zip(rows.column("keys_").to_pylist(), rows.column("counts_").to_pylist(), strict=True):
        full = np.zeros((len(raw) // 6, 8), np.uint8)
        full[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
        keys.append(full.view("<u8").ravel())
        many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(full)).astype(bool))
    key, shared = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    out, at = [], 0
    for block, k in zip(blocks, keys, strict=True):
        part = shared[at : at + len(k)]
        at += len(k)
        if part.any():
            out.append((block, bucket, np.packbits(part).tobytes()))
    return _table(out, ANSWER)


def _sets(buckets: int, frequent):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], SETS)
        block = Block(docs, frequent.value)
        shared = np.zeros(len(block.entry_key), bool)
        place = {b: (a, e) for b, a, e in _slices(_bucket(block.entry_key, buckets))}
        for row in answers.to_pylist():
            a, e = place[row["bucket_"]]
            shared[a:e] = np.unpackbits(np.frombuffer(row["bits_"], np.uint8), count=e - a)
        keys = block.region_keys(shared)
        rows = []
        hashes = docs.column("text_hash").to_pylist()
        for k, (doc_id, text_hash, n, sig) in enumerate(zip(block.ids, hashes, block.n.tolist(), block.sig.tolist(), strict=True)):
            raw = block.values[block.offsets[k] : block.offsets[k + 1]].tobytes() if k in keys else None
            rows.append((doc_id, text_hash, n, sig, keys.get(k), raw))
        return _table(rows, SETS)

    return run


def _groups(rows: pa.Table, names: list[str]) -> Iterator[tuple[int, int]]:
    columns = [rows.column(c).to_numpy() for c in names]
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    yield from zip(first.tolist(), np.r_[first[1:], rows.num_rows].tolist(), strict=True)


def _compare(rows: pa.Table) -> pa.Table:
    """Intersection of every member's set with its pivot's, group by group."""
    rows = rows.sort_by([(c, "ascending") for c in ("pivot", "part", "sig")])
    pivot, sig = rows.column("pivot").to_numpy(), rows.column("sig").to_numpy()
    raw = rows.column("shingles").to_pylist()
    out: list[tuple] = []
    for a, e in _groups(rows, ["pivot", "part"]):
        own = np.frombuffer(raw[a + int(np.flatnonzero(sig[a:e] == pivot[a])[0])], np.uint64)
        for i in range(a, e):
            if sig[i] != pivot[i]:
                other = np.frombuffer(raw[i], np.uint64)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                same = int((own[at] == other).sum())
                out.append((int(sig[i]), int(pivot[i]), same, len(own) + len(other) - same))
    return _table(out, VERDICT)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Frequent shingles by matrix products, rare ones by their few pairs."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    same = np.zeros((count, count), np.float32)
    dense = times > DENSE
    number = np.cumsum(dense) - 1
    hit = dense[column]
    rows, columns = owner[hit], number[column[hit]]
    for a in range(0, int(dense.sum()), COLUMNS):
        part = (columns >= a) & (columns < a + COLUMNS)
        x = np.zeros((count, COLUMNS), np.float32)
        x[rows[part], columns[part] - a] = 1
        same += x @ x.T
    hit = ~hit & (times[column] > 1)
    order = np.argsort(column[hit], kind="stable")
    rows, columns = owner[hit][order], column[hit][order]
    for step in range(1, DENSE):
        pair = columns[step:] == columns[:-step]
        if not pair.any():
            break
        np.add.at(same, (rows[:-step][pair], rows[step:][pair]), 1)
        np.add.at(same, (rows[step:][pair], rows[:-step][pair]), 1)
    return same


def _forest(rows: pa.Table) -> pa.Table:
    """Spanning forest of the links in every meeting."""
    rows = rows.sort_by([(c, "ascending") for c in ("pivot", "a", "b", "sig")])
    sig, raw = rows.column("sig").to_numpy(), rows.column("shingles").to_pylist()
    out: list[tuple] = []
    for a, e in _groups(rows, ["pivot", "a", "b"]):
        if e - a < 2:
            continue
        sets = [np.frombuffer(r, np.uint64) for r in raw[a:e]]
        n = np.array([len(s) for s in sets], np.float64)
        same = intersections(sets).astype(np.float64)
        linked = 100 * same >= PERCENT * (n[:, None] + n[None, :] - same)
        new = np.ones(e - a, bool)
        for start in range(e - a):
            if not new[start]:
                continue
            new[start], front = False, [start]
            while front:
                member = front.pop()
                found = np.flatnonzero(linked[member] & new)
                new[found] = False
                front += found.tolist()
                out += [(int(sig[a + member]), int(sig[a + f])) for f in found]
    return _table(out, LINKS)


LINKS = "sig long, pivot long"
VERDICT = "sig long, pivot long, same long, either long"
WIDE = 1 << 20


class Regions:
    """The steps of one join; each table is written once into a folder of its own."""

    def __init__(self, sets: DataFrame, at: str):
        self.spark, self.at, self.made = sets.sparkSession, at, 0
        self.sets = sets.select("sig", "shingles")
        self.sizes = self.keep(sets.select("sig", F.length("shingles").cast("long").alias("bytes")))

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.parquet(f"{self.at}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{self.made}")

    def _in_groups(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """``rows`` with their sets, in groups of bounded size that never cut ``by``."""
        size = rows.join(self.sizes, "sig").agg(F.sum("bytes")).first()[0] or 0
        groups = parts_for(size, GROUP_BYTES, least_parts(self.spark))
        full = rows.join(self.sets, "sig").withColumn("group_", F.pmod(F.xxhash64(*by), F.lit(groups)))
        return full.repartition(groups, "group_").groupBy("group_")

    def meetings(self, members: DataFrame) -> DataFrame:
        """(pivot, a, b, sig): who meets, from the members (pivot, sig) of all regions."""
        sizes = self.keep(members.groupBy("pivot").agg(F.count("*").alias("count")))
        small = members.join(sizes.where(F.col("count") <= REGION), "pivot")
        met = small.select("pivot", F.lit(0).alias("a"), F.lit(0).alias("b"), "sig")
        large = sizes.where(F.col("count") > REGION)
        if large.isEmpty():
            return met
        split = large.select("pivot", F.ceil(F.col("count") / REGION).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part")
        own = split.select("pivot", F.col("pivot").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        others = members.join(split, "pivot").where("sig != pivot").select("pivot", "sig", part)
        told = self._in_groups(others.unionByName(own), ["pivot", "part"]).applyInArrow(_compare, VERDICT)
        distance = F.when(F.col("either") > 0, 1 - F.col("same") / F.col("either")).otherwise(F.lit(1.0))
        placed = self.keep(
            told.select("pivot", "sig", F.floor(distance * RINGS).cast("int").alias("ring"))
            .unionByName(split.select("pivot", F.col("pivot").alias("sig"), F.lit(0).alias("ring")))
        )
        rings = placed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / REGION).cast("int").alias("parts"))
        place = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
        blocks = placed.join(rings, ["pivot", "ring"]).select("pivot", "sig", "ring", (F.col("ring") * WIDE + place).alias("block"))
        listed = rings.select("pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        listed = listed.select("pivot", "ring", (F.col("ring") * WIDE + F.col("part")).alias("block"))
        right = listed.select("pivot", F.col("ring").alias("other_ring"), F.col("block").alias("other"))
        # A ring more than the distance needs, against rounding.
        reach = RINGS * (100 - PERCENT) // 100 + 1
        pairs = listed.join(right, "pivot").where((F.col("block") <= F.col("other")) & (F.col("other_ring") - F.col("ring") <= reach))
        pairs = self.keep(pairs.select("pivot", F.col("block").alias("a"), F.col("other").alias("b")))
        ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
        return met.unionByName(blocks.join(ends, ["pivot", "block"]).select("pivot", "a", "b", "sig"))

    def links(self, members: DataFrame) -> DataFrame:
        met = self.keep(self.meetings(members))
        return self._in_groups(met, ["pivot", "a", "b"]).applyInArrow(_forest, LINKS)

    def components(self, links: DataFrame) -> DataFrame:
        """(sig, component) of all linked sets: alternating large and small stars until nothing changes."""
        edges = self.keep(links.select(F.greatest("sig", "pivot").alias("v"), F.least("sig", "pivot").alias("u")).distinct())
        state = None
        while True:
            both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
            centre = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
            large = both.join(centre, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
            centre = large.groupBy("v").agg(F.min("u").alias("m"))
            small = large.join(centre, "v")
            edges = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u")))
            edges = self.keep(edges.where("v != u").distinct())
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
            if now == state:
                return edges.select(F.col("v").alias("sig"), F.col("u").alias("component")).unionByName(
                    edges.select(F.col("u").alias("sig"), F.col("u").alias("component")).distinct()
                )
            state = now


def set_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with n_shingles and sig, components of linked sets)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))  # at most FREQUENT numbers
    size, least = total_bytes(docs), least_parts(spark)
    blocks, buckets = parts_for(size, BLOCK_BYTES, least), parts_for(size // 6, BUCKET_KEYS, least)
    dealt = docs.withColumn("block_", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition(blocks, "block_")
    # As many partitions as buckets, so that a task's share does not grow with the input.
    sketches = dealt.groupBy("block_").applyInArrow(_sketch(buckets), SKETCH).repartition(buckets, "bucket_")
    answers = sketches.groupBy("bucket_").applyInArrow(_shared, ANSWER)
    at = fresh_path(spark, "jaccard")
    found = dealt.groupBy("block_").cogroup(answers.groupBy("block_")).applyInArrow(_sets(buckets, frequent), SETS)
    found.write.parquet(f"{at}/sets")
    rows = spark.read.schema(SETS).parquet(f"{at}/sets")
    sets = rows.where(F.col("keys").isNotNull())
    join = Regions(sets.dropDuplicates(["sig"]), at)
    keyed = join.keep(sets.select("sig", F.explode("keys").alias("key")).distinct())
    pivots = keyed.groupBy("key").agg(F.min("sig").alias("pivot"), F.count("*").alias("count")).where("count > 1")
    members = join.keep(keyed.join(pivots.select("key", "pivot"), "key").select("pivot", "sig").distinct())
    return rows, join.keep(join.components(join.links(members)))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, linked = set_components(docs)
    own = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))
    own = own.join(linked, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    place = own.join(least, "component").select("sig", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "sig").join(place, "sig")
    return some.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with the smallest id, and of texts that share it the one with the smallest hash.

    Rows decide, not ids: of two texts of one id that do not link, each stays or
    goes with its own component. Rows without an id stay, and so do documents
    without words; of rows equal in id and text one stays.
    """
    rows, linked = set_components(docs)
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    own = rows.where("n_shingles > 0").groupBy("sig").agg(F.min(row).alias("best"))
    own = own.join(linked, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    some = own.groupBy("component").agg(F.min("best").alias("best")).where("best IS NOT NULL").select("best.*")
    empty = rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash").distinct()
    kept = some.unionByName(empty).select(F.col("doc_id").alias("kept_"), F.col("text_hash").alias("kept_hash_"))
    [to] = free_names(docs.columns, "text_hash_")
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(to, F.xxhash64(F.col("text").cast("string")))
    same = (named["doc_id"] == kept["kept_"]) & (named[to] == kept["kept_hash_"])
    named = named.join(kept, same, "left_semi").dropDuplicates(["doc_id", to]).drop(to)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM words),
e AS (SELECT r, len(s) AS n, unnest(s) AS h FROM sets),
met AS (
  SELECT a.r AS x, b.r AS y, a.n + b.n - count(*) AS total, count(*) AS common
  FROM e a JOIN e b USING (h) WHERE a.r <> b.r GROUP BY a.r, b.r, a.n, b.n),
links AS (SELECT x, y FROM met WHERE 100 * common >= 80 * total),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.s)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY reach.a
"""
