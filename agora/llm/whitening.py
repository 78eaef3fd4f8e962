"""Whitening of vectors from an exact integer scatter.

Every entry c becomes the integer x = floor(scale * c) + offset.  Tasks subtract a shift, which changes no covariance, and
accumulate sums and cross-products of y = x - shift without rounding: y is cut into 20-bit digits, products of digits are
summed by matrix products that stay below 2**53, and those go to 64-bit digits of weight 2**20 that carry into as many more as
are needed, so the precision is arbitrary.  Spark adds the digits of all tasks row by row.  A row per length of vectors then
forms n * X'X - S S' in Python's integers, exactly, and only then goes to float, as V = (n * X'X - S S') / n**2, for ``eigh``.

What is gathered in one place is a matrix of the vectors' length, whatever the number of vectors.  Deviations are exact too:
n * x - S is an integer and its squares are summed by digits.  ``identity_error`` is measured on the whitened vectors.

Defined results: a null vector, one with a null or a non-finite entry, and one with an entry whose x needs more than 62 bits
take no part and have no row.  Vectors of different lengths are fitted apart, each length with its own n.  Empty vectors have a
deviation of 0 and no component.  A deviation of more than 38 digits is null.  A component whose eigenvalue is zero to double precision (a constant column, fewer vectors
than entries) has a null ``whitened`` and no part in ``identity_error``, which is null if no component is left; ``explained``
is 0 where all variance is.  Repeated rows and null ids are vectors as others.  All columns of the input are kept; an added
column replaces one of its name.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_folder, written

SCALE, OFFSET = 1024, 100_000
DIGIT = 20
ROWS = 1 << 12
ENTRIES = 1 << 20
SALTS = 256


def digits(y: np.ndarray, width: int = DIGIT) -> list[np.ndarray]:
    """Signed 64-bit integers as digits of ``width`` bits, least first; all but the last are not negative."""
    found = []
    while len(y) and (y.max(initial=0) >= 1 << width or y.min(initial=0) < -(1 << width)):
        found.append(y & ((1 << width) - 1))
        y = y >> width
    return [*found, y]


class Scatter:
    """Sums and cross-products of rows, exact; ``parts[k]`` has weight 2**(20 * k), its last column is the sum of the rows."""

    def __init__(self, length: int):
        self.length, self.n, self.parts = length, 0, {}

    def add(self, y: np.ndarray) -> None:
        """Takes rows of 64-bit integers."""
        for start in range(0, len(y), ROWS):  # 2**12 products of 20 bits each stay below 2**53
            block = y[start : start + ROWS]
            cut = [d.astype(np.float64) for d in digits(block)]
            for k, a in enumerate(cut):
                self._put(k, slice(self.length, None), a.sum(axis=0)[:, None])
                for m, b in enumerate(cut):
                    self._put(k + m, slice(0, self.length), a.T @ b)
            self.n += len(block)

    def _put(self, k: int, columns: slice, values: np.ndarray) -> None:
        """Adds integers below 2**53; a digit that has grown past 2**40 hands the rest to the one of 2**40 times its weight."""
        part = self.parts.setdefault(k, np.zeros((self.length, self.length + 1), dtype=np.int64))
        part[:, columns] += values.astype(np.int64)
        if np.abs(part[:, columns]).max(initial=0) >= 1 << 60:
            self._carry(k)

    def _carry(self, k: int) -> None:
        over = self.parts[k] >> 40
        self.parts[k] &= (1 << 40) - 1
        upper = self.parts.setdefault(k + 2, np.zeros_like(over))
        upper += over
        if np.abs(upper).max(initial=0) >= 1 << 60:
            self._carry(k + 2)

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, digit, values), every value below 2**41, so that 2**22 tasks can be added up."""
        k = 0
        while k <= max(self.parts, default=-1):
            if k in self.parts:
                if np.abs(self.parts[k]).max(initial=0) >= 1 << 40:
                    self._carry(k)
                for i in range(self.length):
                    yield i, k, self.parts[k][i]
            k += 1


def integers(vectors: pa.Array, scale: int, offset: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, rows of x - shift) of the usable vectors, by length and in blocks of at most ENTRIES entries."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    entries = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, ENTRIES // max(1, length))
        for start in range(0, len(places), step):
            some = places[start : start + step]
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * entries[begins[some][:, None] + np.arange(length)])
                good = (np.abs(x) < 2.0**61).all(axis=1)  # false for what is not a number
            yield some[good], x[good].astype(np.int64) + (offset - shift)


def _scattered(column: str, scale: int, offset: int, shift: int):
    def run(batches):
        found: dict[int, Scatter] = {}
        for batch in batches:
            for _, y in integers(_lists(batch.column(column)), scale, offset, shift):
                if len(y):
                    found.setdefault(y.shape[1], Scatter(y.shape[1])).add(y)
        schema = pa.schema([("length", pa.int32()), ("row", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("values", pa.list_(pa.int64()))])
        for length, scatter in found.items():
            # The number of vectors goes with row -1, once.
            yield pa.RecordBatch.from_pylist([{"length": length, "row": -1, "digit": 0, "n": scatter.n, "values": []}], schema=schema)
            for i, k, values in scatter.rows():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((length, i, k, 0, values), schema.types)], schema=schema)

    return run


def _lists(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of one (length, row, digit), read batch by batch."""
    total, n, first = None, 0, None
    for batch in batches:
        first = first if first is not None else batch
        n += sum(batch.column("n").to_pylist())
        for values in batch.column("values"):
            row = values.values.to_numpy(zero_copy_only=False)
            total = row.astype(np.int64) if total is None else total + row
    length, row, digit = (k.as_py() if hasattr(k, "as_py") else k for k in key[:3])
    columns = [pa.array([length], pa.int32()), pa.array([row], pa.int32()), pa.array([digit], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["length", "row", "digit", "n", "values"])


def _model(components: int):
    """The fit of one length from its rows: exact scatter, eigenvectors, eigenvalues over the trace."""

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length")[0].as_py()
        n = sum(table.column("n").to_pylist())
        parts = {(r, k): v for r, k, v in zip(table.column("row").to_pylist(), table.column("digit").to_pylist(), table.column("values")) if r >= 0}
        top = max((k for _, k in parts), default=-1)

        def exact(i: int) -> np.ndarray:
            """Row i of X'X and, last, the sum of column i, in Python's integers."""
            total = np.zeros(length + 1, dtype=object)
            for k in range(top + 1):
                if (i, k) in parts:
                    total += parts[i, k].values.to_numpy(zero_copy_only=False).astype(object) << (DIGIT * k)
            return total

        sums = np.array([exact(i)[length] for i in range(length)], dtype=object)
        v, trace, square = np.zeros((length, length)), 0, n * n
        for i in range(length):
            row = n * exact(i)[:length] - sums[i] * sums
            trace += row[i]
            v[i] = [m / square for m in row]  # the quotient of integers is rounded once
        spread, vectors = np.linalg.eigh(v) if length else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-spread, kind="stable")[:components]
        least = length * np.finfo(float).eps * max(spread.max(initial=0.0), 0.0)
        kept = [max(0.0, float(spread[j])) if spread[j] > least else 0.0 for j in order]
        share = [e / (trace / square) if trace else 0.0 for e in kept]
        out = {"length": length, "n": n, "sums": [str(s) for s in sums], "spread": kept, "explained": share, "vectors": [vectors[:, j].tolist() for j in order]}
        schema = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("spread", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("vectors", pa.list_(pa.list_(pa.float64())))])
        return pa.Table.from_pylist([out], schema=schema)

    return run


def fit(vectors: DataFrame, folder: str, vector: str = "embedding", components: int = 8, scale: int = SCALE, offset: int = OFFSET, shift: int = OFFSET) -> DataFrame:
    """A stored row per length: n, exact sums of x - shift, eigenvalues, their shares of the trace and unit eigenvectors."""
    schema = "length int, row int, digit int, n bigint, values array<bigint>"
    parts = vectors.select(vector).mapInArrow(_scattered(vector, scale, offset, shift), schema)
    keys = ("length", "row", "digit")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy(*keys, "salt").applyInArrow(_added, schema)
    whole = salted.groupBy(*keys).applyInArrow(_added, schema)
    models = whole.groupBy("length").applyInArrow(_model(components), "length int, n bigint, sums array<string>, spread array<double>, explained array<double>, vectors array<array<double>>")
    return written(models, folder)


def deviations(t: np.ndarray) -> list[int]:
    """The sum of squares of each row of 64-bit integers, exact."""
    totals = [0] * len(t)
    for start in range(0, t.shape[1], 1 << 10):  # 2**10 products of 26 bits each stay below 2**63
        cut = digits(t[:, start : start + (1 << 10)], 26)
        for k, a in enumerate(cut):
            for m, b in enumerate(cut):
                for i, s in enumerate(np.einsum("ij,ij->i", a, b).tolist()):
                    totals[i] += s << (26 * (k + m))
    return totals


def _whitened(column: str, models: str, kept: list[str], added: dict[str, pa.DataType], scale: int, offset: int, shift: int):
    """Per usable vector its other columns and the measures; a length's model is read from the folder of models once."""

    def run(batches):
        fs, path = file_system(models)
        fits: dict[int, dict] = {}

        def model(length: int) -> dict:
            if length not in fits:
                if len(fits) >= 4:
                    fits.pop(next(iter(fits)))
                found = pq.read_table(path, filesystem=fs, filters=[("length", "=", length)]).to_pylist()[0]
                sums = [int(s) for s in found["sums"]]
                axes = np.array(found["vectors"], dtype=np.float64).reshape(len(found["vectors"]), length)
                fits[length] = found | {"sums": sums, "axes": axes, "deep": max(map(abs, sums), default=0)}
            return fits[length]

        for batch in batches:
            for places, y in integers(_lists(batch.column(column)), scale, offset, shift):
                if not len(y):
                    continue
                m = model(y.shape[1])
                n = m["n"]
                if n * int(np.abs(y).max(initial=0)) + m["deep"] < 1 << 62:
                    t = n * y - np.array(m["sums"], dtype=np.int64)
                    deviation, centred = deviations(t), t / n
                else:  # beyond 64 bits: Python's integers
                    t = n * y.astype(object) - np.array(m["sums"], dtype=object)
                    deviation, centred = [int(sum(v * v for v in row)) for row in t], (t / n).astype(np.float64)
                on = centred @ m["axes"].T
                scaled = [[x / e**0.5 if e > 0 else None for x, e in zip(row, m["spread"])] for row in on.tolist()]
                rows = batch.select(kept).take(pa.array(places))
                k = len(places)
                measures = [[y.shape[1]] * k, [n] * k, [str(d) for d in deviation], scaled, [m["explained"]] * k]
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, t) for v, t in zip(measures, added.values())]], names=[*kept, *added])

    return run


ADDED = ("n", "deviation", "whitened", "explained", "identity_error")


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: int = SCALE, offset: int = OFFSET, shift: int = OFFSET) -> DataFrame:
    """The usable rows of ``vectors`` with n, deviation (decimal), whitened and explained (a number per component), identity_error.

    ``identity_error`` is the largest absolute entry of the covariance of ``whitened`` minus the identity, over all vectors
    of the length; Spark's covariance is centred before it multiplies.
    """
    folder = new_folder(vectors.sparkSession, "whitening")
    rows = vectors.select(*[c for c in vectors.columns if c == vector or c not in ADDED])
    fit(rows, f"{folder}/models", vector, components, scale, offset, shift)
    added = {"__length": pa.int32(), "n": pa.int64(), "__deviation": pa.string(), "whitened": pa.list_(pa.float64()), "explained": pa.list_(pa.float64())}
    kept = [c for c in rows.columns if c not in added]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    schema = f"{fields}, __length int, n bigint, __deviation string, whitened array<double>, explained array<double>"
    found = written(rows.mapInArrow(_whitened(vector, f"{folder}/models", kept, added, scale, offset, shift), schema), f"{folder}/whitened")
    found = found.withColumn("deviation", F.col("__deviation").try_cast("decimal(38,0)")).drop("__deviation")

    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = lambda k: F.get("whitened", F.lit(k))
    apart = [F.abs(F.covar_pop(at(i), at(j)) - F.lit(1.0 if i == j else 0.0)) for i, j in pairs]
    errors = found.groupBy("__length").agg(F.array_max(F.array(*apart)).alias("identity_error"))
    errors = written(errors.withColumnRenamed("__length", "__of"), f"{folder}/errors")
    # A row per length of vectors: a table no larger than the longest vector.
    joined = found.join(F.broadcast(errors), F.col("__length") == F.col("__of"))
    return joined.select(*kept, *ADDED)


def by_component(whitened: DataFrame, *columns: str) -> DataFrame:
    """A row per vector and component, numbered from 1, with ``columns`` and the measures."""
    each = F.posexplode(F.arrays_zip(F.col("whitened").alias("whitened"), F.col("explained").alias("explained"))).alias("__at", "__of")
    flat = whitened.select(*columns, "n", "deviation", "identity_error", each)
    return flat.select(*columns, (F.col("__at") + 1).alias("component"), "n", "deviation", F.col("__of.whitened").alias("whitened"), F.col("__of.explained").alias("explained"), "identity_error")
