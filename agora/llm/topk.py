"""Exact top-k inner-product search by pivot-table elimination.

A pivot table holds each vector's distances to a few dozen pivots.  By the triangle inequality the largest difference
between a query's and a candidate's distances to a pivot is a lower bound on their distance, and with the two norms an
upper bound on their inner product.  A query's candidates are evaluated in the order of that bound, until no bound left
reaches the k-th best score; what is skipped cannot be in the result, ties included.  Pivots come from a bounded sample;
they only decide how much is skipped.

Queries and candidates are packed into blocks of bounded size, by their nearest pivot where that has many.  A block of
queries and one of candidates meet in a task of their own, in rounds: each round takes about eight times as many blocks
of candidates as those before it, and starts from the k best found so far.  So a query's k-th score is carried over all
blocks, a pair of blocks whose ranges of pivot distances cannot reach the least k-th score of its queries is never sent,
and a round yields some 8 * k rows per query, not k per block.  Blocks, and the scores that a round starts from, lie in files of
the shared folder; pairs of blocks carry places only.  Where bounds are loose the work is queries times vectors.

Defined results: components become floor(scale * x).  A vector that is null, or has a null or non-finite component, or
whose id is null, takes no part; vectors are compared with those of as many components.  Repeated rows (same id and
components) count once, and a query never meets its own id.  Ties go to the smaller id.  Scores beyond 64 bits saturate.
An empty table gives an empty table.  Other columns are left alone.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, new_folder, written

QUERY_BLOCK, BLOCK, PIVOTS, PIVOT_SAMPLE, GROWTH = 4096, 2048, 32, 256, 8
HEADS, FILES_BYTES = 256, 64 << 20


def integers(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v) with floor(scale * x) for the vectors that take part, each once."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return part.select(F.col(vec_id).cast("bigint").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def choose_pivots(sample: list[list[int]], n: int) -> dict[int, np.ndarray]:
    """Per number of components: vectors far from each other, each next one the farthest from those before."""
    chosen = {}
    for dim in {len(v) for v in sample}:
        same = [v for v in sample if len(v) == dim]
        own = np.array(same, dtype=np.float64).reshape(len(same), dim)
        at, apart = [0], np.linalg.norm(own - own[0], axis=1)
        while len(at) < n and apart.max() > 0:
            at.append(int(apart.argmax()))
            apart = np.minimum(apart, np.linalg.norm(own - own[at[-1]], axis=1))
        chosen[dim] = own[at]
    return chosen


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; in floating point while all sums stay below 2 ** 53."""
    if not len(q) or float(np.abs(c).max(initial=0)) * float(np.abs(q).max()) * len(q) < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(row, q)) for row in c]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in exact], dtype=np.int64)


def search_block(qi, qv, qd, ci, cv, cd, k: int, floor: np.ndarray | None = None):
    """Top k of each query among the candidates that reach its ``floor``: yields (query id, ids, scores)."""
    nq, nc = (qv.astype(np.float64) ** 2).sum(1), (cv.astype(np.float64) ** 2).sum(1)
    exact = cv.astype(np.float64) if float(np.abs(cv).max(initial=0)) < 2**20 else cv
    floor = np.full(len(qi), -np.inf) if floor is None else floor
    for start in range(0, len(qi), 128):
        rows = slice(start, start + 128)
        apart = np.zeros((len(qi[rows]), len(ci)))
        for p in range(qd.shape[1]):
            np.maximum(apart, np.abs(qd[rows, p, None] - cd[None, :, p]), out=apart)
        both = nq[rows, None] + nc[None, :]
        most = (both - apart**2) / 2 + 1 + 1e-9 * both  # rounding of the distances never hides a candidate
        for row in np.flatnonzero((most >= floor[rows, None]).any(axis=1)).tolist():
            bound, own = most[row], start + row
            order = np.flatnonzero(bound >= floor[own])
            order = order[np.argsort(-bound[order], kind="stable")]
            order = order[ci[order] != qi[own]]
            ids, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, max(64, 4 * k)
            while at < len(order) and (len(ids) < k or bound[order[at]] >= scores[-1]):
                some = order[at : at + step]
                ids, scores = np.concatenate([ids, ci[some]]), np.concatenate([scores, _scores(exact[some], qv[own])])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores, at, step = ids[best], scores[best], at + step, 2 * step
            good = scores >= floor[own]
            if good.any():
                yield qi[own], ids[good], scores[good]


def _distances(v: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """Distances to the pivots; a number of components that the sample lacks has none and is searched without bounds."""
    if pivots is None or not len(pivots):
        return np.zeros((len(v), 0))
    return np.stack([np.linalg.norm(v.astype(np.float64) - p, axis=1) for p in pivots], axis=1)


def _celled(dims_of: dict[int, np.ndarray]):
    """Adds to vectors the number of their nearest pivot."""

    def run(batches):
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                d = _distances(np.array([v], dtype=np.int64).reshape(1, len(v)), dims_of.get(len(v)))
                cells.append(int(d.argmin()) if d.size else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _filed(folder: str, pack, names: list[str], types: list[pa.DataType]):
    """Writes what ``pack`` makes of the rows of a batch, pairs of a row and its bytes, to a file of the task's own: the rows, with
    file, place and size.  A file's name is drawn by the attempt that writes it."""

    def run(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, at = uuid.uuid4().int >> 65, 0
        kinds = [*types, pa.int64(), pa.int64(), pa.int64()]
        with fs.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                rows = []
                for row, data in pack(batch):
                    out.write(data)
                    rows.append((*row, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=[*names, "file", "place", "size"])

    return run


class _Files:
    """Reads places in the files of a folder; the bytes read last stay in memory, up to FILES_BYTES."""

    def __init__(self, folder: str):
        (self.fs, self.path), self.kept, self.bytes = file_system(folder), OrderedDict(), 0

    def read(self, at: dict) -> bytes:
        key = (at["file"], at["place"])
        if key not in self.kept:
            with self.fs.open_input_file(f"{self.path}/{key[0]}") as file:
                self.kept[key] = file.read_at(at["size"], key[1])
            self.bytes += at["size"]
            while self.bytes > FILES_BYTES and len(self.kept) > 1:
                self.bytes -= len(self.kept.popitem(last=False)[1])
        self.kept.move_to_end(key)
        return self.kept[key]


def _packed(folder: str, dims_of: dict[int, np.ndarray]):
    """Per block: the ranges of its distances to the pivots, and where its ids, components and distances are."""

    def pack(batch):
        for dim, cell, part, members in zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "part", "members"))):
            ids = np.array([m["id"] for m in members], dtype="<i8")
            v = np.array([m["v"] for m in members], dtype="<i8").reshape(len(ids), dim)
            d = _distances(v, dims_of.get(dim))
            wide = bool(len(ids) and np.abs(v).max(initial=0) >= 2**31)
            norm = float((v.astype(np.float64) ** 2).sum(1).max(initial=0))
            yield (dim, cell, part, len(ids), wide, norm, d.min(0).tolist(), d.max(0).tolist()), ids.tobytes() + v.astype("<i8" if wide else "<i4").tobytes() + d.astype("<f8").tobytes()

    return _filed(folder, pack, ["dim", "cell", "part", "n", "wide", "norm", "low", "high"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())])


def _floors(folder: str):
    """Per block of queries: their number with a floor, the least of it, and where ids and floors are."""

    def pack(batch):
        for dim, qcell, qpart, members in zip(*(batch.column(c).to_pylist() for c in ("dim", "qcell", "qpart", "members"))):
            both = np.array([(m["id"], m["score"]) for m in members], dtype="<i8").reshape(-1, 2)
            yield (dim, qcell, qpart, len(both), int(both[:, 1].min())), both.tobytes()

    return _filed(folder, pack, ["dim", "qcell", "qpart", "fn", "least"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])


PLACE = "file bigint, place bigint, size bigint"
BLOCKS = f"dim int, cell int, part bigint, n bigint, wide boolean, norm double, low array<double>, high array<double>, {PLACE}"


def _unpacked(data: bytes, n: int, dim: int, wide: bool):
    width = 8 if wide else 4
    ids, rest = np.frombuffer(data, "<i8", n), data[8 * n :]
    v, d = np.frombuffer(rest, f"<i{width}", n * dim).reshape(n, dim).astype(np.int64), np.frombuffer(rest[width * n * dim :], "<f8")
    return ids, v, d.reshape(n, -1) if n and len(d) else np.zeros((n, 0))


def _search(folder: str, k: int):
    def run(batches):
        files = _Files(folder)
        for batch in batches:
            for dim, n, wide, at, qn, qwide, qat, fat in zip(*(batch.column(c).to_pylist() for c in ("dim", "n", "wide", "at", "qn", "qwide", "qat", "fat"))):
                asked = _unpacked(files.read(qat), qn, dim, qwide)
                floor = np.full(len(asked[0]), -np.inf)
                if fat is not None:
                    both = np.frombuffer(files.read(fat), "<i8").reshape(-1, 2)
                    both = both[np.argsort(both[:, 0])]
                    place = np.minimum(np.searchsorted(both[:, 0], asked[0]), len(both) - 1)
                    floor = np.where(both[place, 0] == asked[0], both[place, 1].astype(np.float64), -np.inf)
                # A score near the limits of 64 bits is rounded as a float; its floor is then one step lower.
                floor = np.where(np.abs(floor) >= 2**53, np.nextafter(floor, -np.inf), floor)
                found = [(np.full(len(ids), own), ids, scores) for own, ids, scores in search_block(*asked, *_unpacked(files.read(at), n, dim, wide), k, floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` holds for, its k best other rows."""
    spark = vectors.sparkSession
    folder = new_folder(spark, "topk")
    points = written(integers(vectors, vec_id, vector, scale).withColumn("dim", F.size("v")), f"{folder}/points")
    asked = integers(vectors.where(queries), vec_id, vector, scale).withColumn("dim", F.size("v"))
    sample = [list(r.v) for r in points.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()]
    pivots = choose_pivots(sample, PIVOTS)

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        """(rows with their block, blocks); pivots with few vectors share blocks."""
        celled = written(df.mapInArrow(_celled(pivots), "id bigint, v array<bigint>, dim int, cell int"), f"{folder}/{name}-celled")
        n = celled.groupBy("dim", F.col("cell").alias("__cell")).agg(F.count("*").alias("__n"))
        n = n.withColumn("cell", F.when(2 * F.col("__n") >= size, F.col("__cell")).otherwise(-1))
        together = n.groupBy("dim", "cell").agg(F.ceil(F.sum("__n") / size).alias("__parts"))
        n = n.join(together, ["dim", "cell"]).select(F.col("dim").alias("__dim"), "__cell", F.col("cell").alias("__into"), "__parts")  # rows per number of components and pivot
        dealt = celled.join(n, (F.col("dim") == F.col("__dim")) & (F.col("cell") == F.col("__cell")))
        dealt = dealt.select("id", "v", "dim", F.col("__into").alias("cell"), F.pmod(F.xxhash64("id"), F.col("__parts")).alias("part"))
        packed = dealt.groupBy("dim", "cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("members")).mapInArrow(_packed(f"{folder}/data", pivots), BLOCKS)
        return dealt.select("id", "dim", "cell", "part"), written(packed, f"{folder}/{name}-blocks")

    at, few = blocks(asked, QUERY_BLOCK, "query")
    _, many = blocks(points, BLOCK, "candidate")
    at = written(at, f"{folder}/query-places")
    turn = F.pmod(F.xxhash64("dim", "cell", "part"), F.lit(1 << 40)) / float(1 << 40)  # blocks come in any order, but always the same
    n_blocks, begin, step, best = many.count(), 0.0, 2.0, None
    key, place = ["dim", "qcell", "qpart"], F.struct("file", "place", "size")
    asking = few.select("dim", F.col("cell").alias("qcell"), F.col("part").alias("qpart"), F.col("n").alias("qn"), F.col("wide").alias("qwide"), F.col("norm").alias("qnorm"), F.col("low").alias("qlow"), F.col("high").alias("qhigh"), place.alias("qat"))
    # Heads of blocks meet in parts of some HEADS blocks of candidates each, so no task has all of a number of components.
    parts = max(1, -(-n_blocks // HEADS))
    salt = F.pmod(F.xxhash64("dim", "cell", "part", F.lit(1)), F.lit(parts))
    heads = many.select("dim", "cell", "part", "n", "wide", "norm", "low", "high", place.alias("at")).withColumns({"__turn": turn, "__salt": salt})
    asking = written(asking.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))), f"{folder}/asking")
    while best is None or begin < 1:
        end = step / n_blocks if n_blocks else 1.0
        asked_now = asking
        if best is None:
            asked_now = asking.withColumns({"__least": F.lit(None).cast("bigint"), "fat": F.lit(None).cast("struct<file: bigint, place: bigint, size: bigint>")})
        else:
            full = best.groupBy("query_id").agg(F.count("*").alias("__n"), F.min("score").alias("score")).where(F.col("__n") >= k)
            known = at.join(full, F.col("id") == F.col("query_id")).select("dim", F.col("cell").alias("qcell"), F.col("part").alias("qpart"), F.struct("id", "score").alias("__f"))
            floors = known.groupBy(*key).agg(F.collect_list("__f").alias("members")).mapInArrow(_floors(f"{folder}/data"), f"dim int, qcell int, qpart bigint, fn bigint, least bigint, {PLACE}")
            floors = written(floors, f"{folder}/floors-{step}").select(*key, "fn", "least", place.alias("fat"))
            asked_now = asking.join(floors, key, "left").withColumn("__least", F.when(F.col("fn") >= F.col("qn"), F.col("least")))
        gaps = F.zip_with(F.zip_with("low", "qhigh", lambda a, b: a - b), F.zip_with("qlow", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
        both = F.col("norm") + F.col("qnorm")
        most = (both - F.pow(F.coalesce(F.array_max(gaps), F.lit(0.0)), 2)) / 2 + 1 + 1e-9 * both
        pairs = heads.where((F.col("__turn") >= begin) & (F.col("__turn") < end)).join(asked_now, ["dim", "__salt"])
        pairs = pairs.where(F.col("__least").isNull() | (most >= F.col("__least").cast("double") - 1))
        # Only pairs of blocks that can reach a floor go on, as places; a task reads its blocks in turn.
        work = pairs.select("dim", "n", "wide", "at", "qn", "qwide", "qat", "fat").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)).sortWithinPartitions("qat", "at")
        near = work.mapInArrow(_search(f"{folder}/data", k), "query_id bigint, vec_id bigint, score bigint")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = near if best is None else near.union(best.select("query_id", "vec_id", "score"))
        best = written(found.withColumn("rank", order).where(F.col("rank") <= k), f"{folder}/best-{step}")
        begin, step = end, step * GROWTH
    return best.select("query_id", "rank", "vec_id", "score")
