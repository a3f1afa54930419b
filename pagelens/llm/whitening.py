"""Operator 12: whitening of embeddings from upper-triangle column aggregates.

Three aggregations without a key, each pre-aggregated by task, so that no row
but their sums reaches the driver: the exact sums of all dimensions; for every
pair of dimensions (i <= j) the sum of products of the centred entries, as SQL
expressions that are generated for all pairs in one aggregation; and, as a
check, the covariances of the whitened columns.  LAPACK decomposes the
covariance, whose size depends on the number of dimensions alone.

An entry c becomes the long floor(1024 * c) + 100000.  Rows go whose vector is
null or empty, or holds null or non-finite entries; an entry beyond
``MOST`` after scaling has no exact long and counts as non-finite.  Vectors of
each length are a fit list of their own.  Pairs beyond ``most_sums`` go to a
further aggregation (2,080 pairs of 64 dimensions are one).

A component whose eigenvalue is zero (to rounding) has ``whitened`` 0.0; so has
every component of a single vector, where ``explained`` is 0.0 and
``identity_error`` 1.0.  ``deviation`` is null where it exceeds a long.  Ids
are carried as they are, repeated and null ones too.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Fixed value: doubles are exact integers up to here.
MOST = float(1 << 53)


def scaled_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose entries are all sound."""
    scaled = F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * SCALE)
    # NaN is greater than all numbers, so the comparison also drops it; null makes it null.
    sound = F.forall("scaled", lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("scaled"))
    return rows.filter(sound & (F.size("scaled") > 0)).select("vec_id", F.transform("scaled", lambda c: F.floor(c).cast("long") + SHIFT).alias("x"))


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""
    r = rows.selectExpr("count(*) AS n", *[f"try_sum(x[{i}]) AS s{i}" for i in range(dim)]).first()
    if None in r:
        r = rows.selectExpr("count(*) AS n", *[f"sum(CAST(x[{i}] AS DECIMAL(28, 0))) AS s{i}" for i in range(dim)]).first()
    return r[0], [int(v) for v in r[1:]]


def pair_sums(dim: int) -> list[str]:
    """SQL of the sum of centred products of every pair of dimensions, the upper triangle by rows."""
    return [f"sum(c{i} * c{j})" for i in range(dim) for j in range(i, dim)]


def covariance(rows: DataFrame, dim: int, n: int, total: list[int], most_sums: int = 4096) -> np.ndarray:
    """The covariance (divisor n) of all dimensions."""
    centred = rows.select(*[(F.get("x", F.lit(i)).cast("double") - F.lit(total[i] // n).cast("double") - F.lit(total[i] % n / n)).alias(f"c{i}") for i in range(dim)])
    pairs, found = pair_sums(dim), []
    for a in range(0, len(pairs), most_sums):
        found += centred.selectExpr(*[f"{p} AS p{a + k}" for k, p in enumerate(pairs[a : a + most_sums])]).first()
    upper = np.zeros((dim, dim))
    upper[np.triu_indices(dim)] = np.array(found, dtype=np.float64) / n
    return upper + np.triu(upper, 1).T


def decompose(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; eigenvalues that are zero to rounding are zero."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    values[values <= len(values) * np.finfo(float).eps * max(values[0], 0.0)] = 0.0
    return values, vectors


def exact_deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, in integers."""
    most = max(1, n * int(np.abs(x).max(initial=0)) + max(map(abs, total)))
    if most * most * len(total) < 1 << 63:
        d = n * x - np.array(total, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    d = n * x if most < 1 << 63 else None
    if d is not None:
        # The differences fit, their squares may not.
        d = d - np.array(total, dtype=np.int64)
        wide = np.abs(d).max(axis=1).astype(np.float64) ** 2 * len(total) > float(1 << 62)
        out = [0] * len(x)
        safe = np.flatnonzero(~wide)
        for k, v in zip(safe.tolist(), (d[safe] * d[safe]).sum(axis=1).tolist()):
            out[k] = v
        exact = [(k, sum(v * v for v in d[k].tolist())) for k in np.flatnonzero(wide).tolist()]
    else:
        out = [0] * len(x)
        exact = [(k, sum((n * v - s) ** 2 for v, s in zip(row, total))) for k, row in enumerate(x.tolist())]
    for k, v in exact:
        out[k] = v if v < 1 << 63 else None
    return out


def project(rows: DataFrame, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray, most: int) -> DataFrame:
    """(vec_id, deviation, w0, w1, ...) of every row."""
    k = min(most, len(values))
    basis = np.zeros((len(values), k))
    real = values[:k] > 0
    basis[:, real] = vectors[:, :k][:, real] / np.sqrt(values[:k][real])
    whole, rest = np.array([s // n for s in total], dtype=np.int64), np.array([s % n / n for s in total])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            w = ((x - whole).astype(np.float64) - rest) @ basis
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact_deviation(x, n, total), pa.int64()), *(pa.array(np.ascontiguousarray(w[:, c])) for c in range(k))], names=["vec_id", "deviation", *(f"w{c}" for c in range(k))])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, " + ", ".join(f"w{c} double" for c in range(k)))


def identity_error(projected: DataFrame, k: int) -> float:
    """The largest entry of the whitened columns' covariance minus the identity, read from the rows."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = projected.selectExpr(*[f"covar_pop(w{i}, w{j}) AS v{i}_{j}" for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(r, pairs))


def _whiten_length(rows: DataFrame, dim: int, most: int, most_sums: int) -> DataFrame:
    n, total = sums(rows, dim)
    values, vectors = decompose(covariance(rows, dim, n, total, most_sums))
    projected = project(rows, n, total, values, vectors, most)
    k, trace = min(most, dim), float(values.sum())
    error = identity_error(projected, k)
    number: Column = F.posexplode(F.array(*[F.struct(F.col(f"w{c}").alias("whitened"), F.lit(float(values[c] / trace) if trace else 0.0).alias("explained")) for c in range(k)]))
    out = projected.select("vec_id", "deviation", number.alias("at", "c"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 8, most_sums: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row and component."""
    rows = scaled_vectors(vectors, id_col, vec_col)
    dims = [r[0] for r in rows.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect()]  # one row per vector length
    out = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dim in dims:
        part = _whiten_length(rows.filter(F.size("x") == dim), dim, components, most_sums)
        out = part if len(dims) == 1 else out.unionByName(part)
    return out
