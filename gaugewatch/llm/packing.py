"""Documents packed into as few training sequences of a fixed length as possible.

1. Documents are encoded where they lie. Each becomes one piece, or several if
   it is longer than a sequence: then the first piece takes the remainder and
   all others are full. Pieces are rows of numbers; texts are never shuffled.
2. Pieces are dealt into parts of bounded size. Each part is packed best-fit
   decreasing, and dual feasible functions give a lower bound for its number
   of sequences: a part that meets its bound is certified and done.
3. Parts that miss their bound hand over the pieces of their sequences with
   gaps. These are dealt into fewer, mixed parts and packed again, as long as
   that saves sequences (and at most ``MAX_ROUNDS`` times); a round that saves
   none is discarded. Only counts reach the driver.

Null text is empty; an empty text is the end id alone, so every row has a
piece. Repeated rows and repeated or null ids are packed like any others; an
empty table gives an empty result. Columns other than the id and the text are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewatch.llm.common import batches
from gaugewatch.llm.tokens import default_file, encoder
from gaugewatch.session import fresh_path

LENGTH = 2048
END = 0
PART_PIECES = 65_536
MAX_ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, part long, bin long, offset long, fill long, bins long, bound long"


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: the remainder first, then full ones."""
    count = -(-n // length)
    return [n - length * (count - 1)] + [length] * (count - 1)


def pieces(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of every document, with the checksum of its ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches(source, 2 << 20):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), length)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start += n
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, each into the fullest bin that takes it.

    Open bins are kept by their gap, and the gaps in use as bits of one
    number, so the tightest bin is the lowest set bit above the item's length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = used >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            place = by_gap[gap].pop()
            if not by_gap[gap]:
                used &= ~(1 << gap)
        else:
            gap, place = capacity, count
            count += 1
        bins[i], offsets[i] = place, capacity - gap
        if gap > size:
            by_gap[gap - size].append(place)
            used |= 1 << (gap - size)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least; ``counts[x]`` items have length x.

    The maximum over two families of dual feasible functions: f0 with every
    threshold t (items over capacity - t count as full, those below t as
    nothing), and the rounding functions u(k).
    """
    x = np.arange(capacity + 1)
    total = np.cumsum(counts * x)
    number = np.cumsum(counts)
    best = -(-int(total[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        full = int(number[-1] - number[capacity - t])
        middle = int(total[capacity - t] - total[t - 1])
        best = max(best, full + -(-middle // capacity))
    for k in range(1, 31):
        exact = (x * (k + 1)) % capacity == 0
        # In units of 1 / (k * capacity), so that all values are integers.
        value = np.where(exact, x * k, ((k + 1) * x // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(rows: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Deal pieces into ``parts`` parts by hash and pack each one."""
    dealt = rows.withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(salt)), F.lit(parts)).cast("long")
    )

    def run(table: pa.Table) -> pa.Table:
        # The order of rows decides ties, so a repeated task must see the same one.
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        for name, values in (
            ("bin", bins), ("offset", offsets), ("fill", fill[bins]),
            ("bins", np.full(len(bins), count)), ("bound", np.full(len(bins), bound)),
        ):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.select([c.split()[0] for c in PACKED.split(", ")])

    return dealt.groupBy("part").applyInArrow(run, PACKED)


def pack(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, length: int = LENGTH, part_pieces: int = PART_PIECES
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``sequence_id`` holds the round, the part and the number in the part.
    """
    spark = docs.sparkSession
    if path is None:
        path, pattern = default_file()
    at = fresh_path(spark, "packing")
    pieces(docs, path, pattern, length).write.parquet(f"{at}/pieces")
    rest = spark.read.schema(PIECES).parquet(f"{at}/pieces")
    done: list[DataFrame] = []
    before, held = None, 0
    for turn in range(MAX_ROUNDS):
        parts = max(1, math.ceil(rest.count() / part_pieces))
        _pack(rest, parts, turn, length).write.parquet(f"{at}/{turn}")
        packed = spark.read.schema(PACKED).parquet(f"{at}/{turn}")
        # A part that meets its bound is optimal; of the others, full sequences stay.
        exchange = (F.col("bins") > F.col("bound")) & (F.col("fill") < length)
        # Every sequence has one piece at offset 0.
        heads = packed.where("offset = 0").agg(F.count("*").alias("all"), F.count_if(exchange).alias("open")).first()
        if before is not None and heads["all"] >= held:
            done.append(before)
            break
        ids = packed.withColumn(
            "sequence_id", F.lit(turn) * F.lit(1 << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        )
        if not heads["open"] or parts == 1 or turn == MAX_ROUNDS - 1:
            done.append(ids)
            break
        done.append(ids.where(~exchange))
        before, held = ids.where(exchange), heads["open"]
        rest = packed.where(exchange).select("doc_id", "piece", "start", "length", "ids_crc32")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
