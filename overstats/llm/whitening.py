"""Embedding whitening: an exact distributed covariance, single-precision eigenvectors refined in higher precision.

Entries become whole numbers (``SCALE`` steps to a unit), so all sums over rows are exact and in no need of an order:
tasks centre the vectors at the rounded mean, multiply blocks of them as limbs whose products a double holds without
rounding, and Spark adds the tasks' sums. What reaches the driver is one matrix of dimensions x dimensions.

There, eigenvectors in single precision are corrected by the iteration of Ogita and Aishima: matrix products alone, in
extended precision, double the right digits each time. Eigenvalues closer than the bound of the iteration form clusters;
within a cluster it only mends orthogonality, and the directions come from the small problem that is left in the span of
the cluster, shifted, scaled and solved in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overstats.llm.store import map_batches, save

SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 16
#: Entries of this size and beyond (scaled) have no long whole number.
WIDEST = 2.0**62
#: Bits of a limb, and rows whose products of limbs a double adds up exactly.
LIMB, ROWS = 20, 1 << 13
#: Blocks of rows after which a task passes on its sums, long before a long overflows.
BLOCKS = 256
ROUNDS = 40
#: The precision that corrects: extended doubles where the machine has them.
HIGH = np.longdouble


def whole(vector: F.Column) -> F.Column:
    """The whole numbers of a vector; null if it is null or has an entry that is null, not finite or too large."""
    entries = F.transform(vector, lambda c: c.cast("double") * SCALE)
    good = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < WIDEST), F.lit(False)))
    return F.when(good, F.transform(entries, lambda c: F.floor(c).cast("long") + F.lit(SHIFT).cast("long")))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a batch of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of ``fit`` (x: array<long>) and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix_of(batch.column(0))
            if len(x):
                n, high, low = n + len(x), high + (x >> 31).sum(0), low + (x & (2**31 - 1)).sum(0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = map_batches(fit, run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()
    found = sorted(found, key=lambda r: r.i)
    return (found[0].n if found else 0), [(int(r.high) << 31) + int(r.low) for r in found]


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles l with y = sum of l[k] * 2 ** (LIMB * k), all but the last from 0 up to 2 ** LIMB."""
    out = []
    while len(y) and np.abs(y).max() >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def products(fit: DataFrame, centre: list[int]) -> list[list[int]]:
    """Exact sums over the rows of ``fit`` of (x - centre)_i * (x - centre)_j."""
    d, middle = len(centre), np.array(centre, np.int64)
    upper = np.triu_indices(d)

    def flushed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        k = np.repeat(np.array(list(sums), np.int32), len(upper[0]))
        i, j = (np.tile(x.astype(np.int32), len(sums)) for x in upper)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k), pa.array(np.concatenate([x[upper] for x in sums.values()]))], names=["i", "j", "k", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            every = matrix_of(batch.column(0)) - middle
            for low in range(0, len(every), ROWS):
                parts = limbs(every[low : low + ROWS])
                for a, left in enumerate(parts):
                    for b, right in enumerate(parts):
                        held[a + b] = held.get(a + b, 0) + (left.T @ right).astype(np.int64)
                blocks += 1
                if blocks % BLOCKS == 0:
                    yield flushed(held)
                    held = {}
        if held:
            yield flushed(held)

    found = map_batches(fit, run, "i int, j int, k int, value long").groupBy("i", "j", "k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = [[0] * d for _ in range(d)]
    for r in found.toLocalIterator():
        out[r.i][r.j] += int(r.value) << (LIMB * r.k)
    return [[out[min(i, j)][max(i, j)] for j in range(d)] for i in range(d)]


def ratio(top: int, bottom: int) -> np.longdouble:
    """top / bottom, rounded once or twice in the higher precision."""
    shift = max(0, bottom.bit_length() + 80 - top.bit_length())
    found, bits = abs(top << shift) // bottom, 0
    while found >> 64:
        found, bits = found >> 1, bits + 1
    value = np.ldexp(HIGH(found >> 32), 32) + HIGH(found & (2**32 - 1))
    return np.ldexp(value if top >= 0 else -value, bits - shift)


def covariance(n: int, moments: list[list[int]], left: list[int]) -> np.ndarray:
    """In higher precision: moments / n less the product of the means ``left`` / n that rounding the centre has left."""
    return np.array([[ratio(n * m - left[i] * left[j], n * n) for j, m in enumerate(row)] for i, row in enumerate(moments)], HIGH).reshape(len(moments), len(moments))


def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Places of two or more values in which each is within ``bound`` of a next one."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    return [x for x in np.split(order, cuts) if len(x) > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in higher precision."""
    d = len(matrix)
    size = np.abs(matrix).max() if d else 0
    if not size:
        return np.zeros(d, HIGH), np.eye(d, dtype=HIGH)
    a = matrix.astype(HIGH) / size
    vectors = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    norm, eps, one = np.sqrt((a * a).sum()), np.finfo(HIGH).eps, np.eye(d, dtype=HIGH)
    last = np.inf
    for _ in range(ROUNDS):
        r, s = one - vectors.T @ vectors, vectors.T @ a @ vectors
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else their rounding, over a small gap, harms orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        vectors = vectors + vectors @ e
        left = np.abs(e).max()
        rough = False
        for at in clusters(values, bound):
            own = vectors[:, at]
            inner = own.T @ (a @ own - values[at].mean() * own)
            inner = (inner + inner.T) / 2
            if np.abs(inner - np.diag(np.diag(inner))).max() > 64 * d * eps:
                if len(at) == d and np.abs(inner).max() > 0.5:  # nothing was told apart: single precision has failed
                    turn = np.linalg.eigh(inner.astype(np.float64))[1].astype(HIGH)
                else:
                    turn = eigen(inner)[1]
                vectors[:, at] = own @ turn
                rough = True
        if not rough and (left <= 16 * d * eps or left >= last):
            break
        last = left if not rough else np.inf
    for _ in range(2):  # where gaps are as small as the rounding, directions are free, but they stay orthogonal
        vectors = vectors + vectors @ (one - vectors.T @ vectors) / 2
    values = (vectors * (a @ vectors)).sum(0) / (vectors * vectors).sum(0) * size
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order] / np.sqrt((vectors * vectors).sum(0))[order]


def signed(vectors: np.ndarray) -> np.ndarray:
    """The largest entry of each column is positive (the first of equal ones)."""
    at = np.abs(vectors).argmax(0) if vectors.size else []
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1, 1) if vectors.size else vectors


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of ``df`` and component: the other columns of ``df``, component, n, deviation (decimal),
    whitened, explained and identity_error. Columns of ``df`` named like the new ones, whatever their case, are replaced.

    Rows go whose vector is null, empty, has an entry that is null or not finite or too large for a long, or another
    length than most vectors (of equally frequent lengths the largest counts). Repeated vectors are fitted once and
    returned for every row. Components without variance are left out, so with one vector, or none, nothing is returned.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    names = [c for c in df.columns if c != vector_col and c.lower() not in new]
    kept = [f"c{k}" for k in range(len(names))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], whole(F.col(f"`{vector_col}`")).alias("x")).where("x is not null and size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    named = [F.col(k).alias(c) for c, k in zip([*names, *new], schema.names)]
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema).select(*named)
    rows = rows.where(F.size("x") == lengths.d)
    fit = save(rows.select("x").distinct(), "vectors")
    n, total = sums(fit)
    centre = [round_half(s, n) for s in total]
    left = [s - n * c for s, c in zip(total, centre)]
    v = covariance(n, products(fit, centre), left)
    values, vectors = eigen(v)
    trace = v.trace()
    many = min(components, int((values > max(values[0], 0) * len(values) * np.finfo(np.float64).eps).sum()))
    if not many:
        return df.sparkSession.createDataFrame([], schema).select(*named)
    turn = (signed(vectors[:, :many]) / np.sqrt(values[:many])).astype(np.float64)
    mean = np.array([float(ratio(x, n)) for x in left])
    middle, explained = np.array(centre, np.int64), (values[:many] / trace).astype(np.float64)
    error = identity_error(fit, middle, mean, turn, n)
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix_of(batch.column(at)) - middle if batch.num_rows else np.zeros((0, len(middle)), np.int64)
            white = (y - mean) @ turn
            far = deviations(y, n, left)
            take = pa.array(np.repeat(np.arange(batch.num_rows), many))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                *[c.take(take) for c in batch.columns[:at]],
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), m)), pa.array(np.full(m * many, n)),
                pa.array(far, pa.decimal128(38, 0)).take(take), pa.array(white.reshape(-1)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * many, error))], names=schema.names)

    return map_batches(rows, run, schema).select(*named)


def round_half(top: int, bottom: int) -> int:
    """top / bottom to the nearest whole number, halves up."""
    return (2 * top + bottom) // (2 * bottom)


def deviations(y: np.ndarray, n: int, left: list[int]) -> list[int]:
    """Sums over the entries of (n * y - left) ** 2, exact: in longs where none can overflow, else in Python's numbers."""
    if not len(y):
        return []
    widest = n * int(np.abs(y).max()) + max(map(abs, left))
    if widest**2 * len(left) < 2**62:
        return ((n * y - np.array(left, np.int64)) ** 2).sum(1).tolist()
    far = y.astype(object) * n - np.array(left, object)
    return (far * far).sum(1).tolist()


def identity_error(fit: DataFrame, middle: np.ndarray, mean: np.ndarray, turn: np.ndarray, n: int) -> float:
    """Largest entry, by size, of the covariance of the whitened rows of ``fit`` minus the identity."""
    many = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((many, many)), np.zeros(many)
        for batch in batches:
            if batch.num_rows:
                white = (matrix_of(batch.column(0)) - middle - mean) @ turn
                gram, total = gram + white.T @ white, total + white.sum(0)
        i, j = (x.reshape(-1).astype(np.int32) for x in np.indices((many, many)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram.reshape(-1)), pa.array(total[i])], names=["i", "j", "product", "total"])

    found = map_batches(fit, run, "i int, j int, product double, total double").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()
    at = {(r.i, r.j): r for r in found}
    return max(abs(r.product / n - r.total / n * at[r.j, r.i].total / n - (r.i == r.j)) for r in found)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
