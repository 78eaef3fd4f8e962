"""Best-fit packing of documents into sequences: best-two-fit over a histogram of lengths.

A bin is filled greedily, always with the longest piece that fits.  If it then has a gap and more than one piece, its
smallest piece is taken out and the two unpacked pieces that fill the larger gap most tightly go in, as long as that
leaves a smaller gap.  Bins only depend on lengths, of which there are at most ``capacity``; so the bins are found on
the histogram of lengths, each kind of bin together with how often it recurs, by one small computation whose input
and output do not grow with the number of documents.  Spark then ranks the pieces of each length and deals ranks to
places.  Ranks are taken in blocks, with a base for each block, so a length that a third of all pieces share is ranked
by many tasks.

Defined results: a null text is an empty document, of its end id only.  A document over ``capacity`` is cut; its first
piece may be shorter, all others are full.  Repeated rows are documents of their own, and ids may be null.  An empty
table gives an empty table.  Columns other than id and text are left alone.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, written
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, kept_words: int = 500_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the pieces of every document."""
    end = struct.pack("<I", end_id)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches):
        encode = encoder(vocabulary, kept_words)
        for batch in batches:
            rows = []
            for own, body in zip(batch.column("__id").to_pylist(), encode.ids_of(batch.column("__text"))):
                ids = body + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    some = ids[4 * at : 4 * (at + (capacity if k else first))]
                    rows.append((own, k, at, len(some) // 4, crc32(some), *([some] * with_ids)))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col(doc_id).cast("bigint").alias("__id"), F.col(text).alias("__text")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def _longest(left: np.ndarray, gap: int) -> int:
    fits = np.flatnonzero(left[1 : gap + 1])
    return int(fits[-1]) + 1 if len(fits) else 0


def _two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """The two unpacked lengths with the largest sum of at most ``gap``; zeros if there are none."""
    at = np.flatnonzero(left[: gap + 1])
    best, low, high = (0, 0), 0, len(at) - 1
    while low <= high:
        a, b = int(at[low]), int(at[high])
        if a + b > gap:
            high -= 1
        elif low == high and left[a] < 2:
            break
        else:
            if a + b > sum(best):
                best = (a, b)
            low += 1
    return best


def bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Kinds of bins as (how often, pieces of each length); together they hold every piece once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    kinds = []
    while len(np.flatnonzero(left)):
        rest, own, gap = left.copy(), {}, capacity
        while length := _longest(rest, gap):
            k = min(int(rest[length]), gap // length)
            own[length] = own.get(length, 0) + k
            rest[length] -= k
            gap -= k * length
        while gap and sum(own.values()) > 1:
            small = min(own)
            pair = _two(rest, gap + small)
            if sum(pair) <= small:
                break
            own[small] -= 1
            rest[small] += 1
            if not own[small]:
                del own[small]
            for length in pair:
                own[length] = own.get(length, 0) + 1
                rest[length] -= 1
            gap += small - sum(pair)
        often = min(int(left[length]) // k for length, k in own.items())
        for length, k in own.items():
            left[length] -= often * k
        kinds.append((often, own))
    return kinds


class Places:
    """Which sequence and offset the piece of a given length and rank gets.  Its size depends on the kinds of bins."""

    def __init__(self, kinds: list[tuple[int, dict[int, int]]]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for often, own in kinds:
            offset = 0
            for length in sorted(own, reverse=True):
                by.setdefault(length, []).append((taken.get(length, 0), own[length], sequence, offset))
                taken[length] = taken.get(length, 0) + often * own[length]
                offset += length * own[length]
            sequence += often
        self._by = {length: np.array(rows, dtype=np.int64).T for length, rows in by.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for own in np.unique(length).tolist():
            at = np.flatnonzero(length == own)
            first, each, base, shift = self._by[own]
            kind = np.searchsorted(first, rank[at], side="right") - 1
            copy, slot = np.divmod(rank[at] - first[kind], each[kind])
            sequence[at], offset[at] = base[kind] + copy, shift[kind] + slot * own
        return sequence, offset


def place(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    total = cut.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 20_000))
    keyed = cut.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counted = written(keyed.groupBy("length", "__block").agg(F.count("*").alias("__n")), new_folder(spark, "packing-counts"))
    histogram = {int(r.length): int(r.n) for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most capacity rows
    where = Places(bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.select("length", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("__own", own).join(based.hint("merge"), ["length", "__block"]).withColumn("__rank", F.col("__base") + F.col("__own") - 1)
    names = list(cut.columns)

    def dealt(batches):
        for batch in batches:
            sequence, offset = where.of(batch.column("length").to_numpy(), batch.column("__rank").to_numpy().copy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, "__rank").mapInArrow(dealt, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, kept_words: int = 500_000) -> DataFrame:
    """A row per piece with its place; with ``with_ids`` also its ids.  A worker remembers the ids of ``kept_words`` words, some 200 bytes each."""
    cut = written(pieces(docs, vocabulary, end_id, capacity, doc_id, text, with_ids, kept_words), new_folder(docs.sparkSession, "packing-pieces"))
    return place(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from a result of ``pack(..., with_ids=True)``; ids as little-endian 32-bit integers."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
