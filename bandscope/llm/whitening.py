"""Whitening of embeddings by one aggregation of column products.

Method. Vectors become whole numbers, and the fit list holds each distinct
vector once. One pass sums its columns exactly. The next aggregation is
generated: a sum of the product of two centred columns for every pair in the
upper triangle, all in one ``agg``, so each row is read once and partial sums
are all that is shuffled. The driver assembles the covariance from that one
row and decomposes it with LAPACK; nothing else of the corpus reaches it. The
covariance of the whitened fit list is then measured, not derived.

Scale. The passes over the fit list are map-side aggregates; the one shuffle of
rows finds distinct vectors, where copies collapse before the exchange. More
than ``PAIRS`` pairs (90 dimensions) are dealt to several aggregations.

Defined edge cases: a vector that is null or holds null or non-finite entries is
dropped, and so is one whose length differs from the most frequent length of
distinct vectors (of equals the longest), as it lacks entries; 64 times an entry
counts as at most 2^62 either way; null ids and repeated rows stay. A component
without variance has ``whitened`` null, ``explained`` 0 (null where there is no
variance at all), and doesn't enter ``identity_error`` (null where none is left).
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
EDGE = float(1 << 62)
#: Components that are returned.
COMPONENTS = 16
#: Pairs of columns in one aggregation.
PAIRS = 4096
#: Vectors that a kernel turns at a time.
ROWS = 4096
#: Exact squares are kept while they have this many digits.
DIGITS = 38


@dataclass(frozen=True)
class Whitening:
    """A fitted transform. ``axes`` holds a unit eigenvector in each column, ``variances`` their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.variances]


def whole_numbers(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is whole and finite, with ``vector_col`` as longs.

    ``array_contains`` is null where a null entry could be the one sought, so the condition drops those vectors too.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = ~F.array_contains(v, F.lit(float("nan"))) & ~F.array_contains(v, F.lit(float("inf"))) & ~F.array_contains(v, F.lit(float("-inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * float(SCALE), F.lit(EDGE)), F.lit(-EDGE))) + F.lit(SHIFT))
    return vectors.where(whole & (F.size(v) > 0)).withColumn(vector_col, x)


def triangle(fit_list: DataFrame, means: list[float]) -> np.ndarray:
    """Sums of centred products for every pair of columns of ``x``, as a symmetric matrix."""
    d = len(means)
    # No entry is null; saying so takes the checks for nulls out of every sum.
    centred = fit_list.select(*((F.coalesce(F.get("x", F.lit(i)), F.lit(0)).cast("double") - F.lit(m)).alias(f"c{i}") for i, m in enumerate(means)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        row = centred.agg(*(F.expr(f"sum(c{i} * c{j})").alias(f"s{i}_{j}") for i, j in some)).first()
        for (i, j), s in zip(some, row):
            out[i, j] = out[j, i] = s
    return out


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to ``x`` (arrays of longs of one length, each once); None for an empty list."""
    first = fit_list.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]
    row = fit_list.agg(F.count("*"), *(F.sum(F.get("x", F.lit(i)).cast("decimal(19,0)")) for i in range(d))).first()
    n, sums = row[0], tuple(int(s) for s in row[1:])
    # Python divides whole numbers exactly rounded.
    covariance = triangle(fit_list, [s / n for s in sums]) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    return Whitening(n, sums, axes[:, order], np.maximum(values[order], 0.0), float(np.trace(covariance)))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """The exact sum over columns of (n*x - S)^2 for each row; null beyond ``DIGITS`` digits."""
    kind = pa.decimal128(DIGITS, 0)
    if not len(x):
        return pa.array([], kind)
    reach = max(float(np.abs(x.astype(np.float64)).max()) * n, float(max(map(abs, sums))))
    if reach < 2.0**62:
        part = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(part.astype(np.float64)).max()) ** 2 * x.shape[1] < 2.0**62:
            return pa.array((part * part).sum(axis=1), pa.int64()).cast(kind)
    part = x.astype(object) * n - np.array(sums, dtype=object)
    return pa.array([Decimal(s) if s < 10**DIGITS else None for s in (part * part).sum(axis=1)], kind)


def project(vectors: DataFrame, fitted: Whitening, id_col: str, vector_col: str) -> DataFrame:
    """``id_col``, ``deviation`` (decimal) and ``whitened`` (array of doubles, one for each component) of each row of whole numbers."""
    n, sums, d = fitted.n, fitted.sums, fitted.dimension
    means = np.array([s / n for s in sums])
    # Below this share of the trace an eigenvalue is rounding.
    lives = fitted.variances > fitted.trace * d * np.finfo(float).eps
    turn = fitted.axes / np.sqrt(np.where(lives, fitted.variances, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy().reshape(-1, d)
                w = (x - means) @ turn
                dead = np.broadcast_to(~lives, w.shape).ravel()
                cells = pa.array(w.ravel(), pa.float64(), mask=dead) if dead.any() else pa.array(w.ravel(), pa.float64())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), deviations(x, n, sums), pa.ListArray.from_arrays(ends, cells)], names=[id_col, "deviation", "whitened"])

    schema = T.StructType([vectors.schema[id_col], T.StructField("deviation", T.DecimalType(DIGITS, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.select(id_col, vector_col).mapInArrow(run, schema)


def identity_error(fit_list: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by one more aggregation."""
    live = [i for i, v in enumerate(fitted.variances) if v > fitted.trace * fitted.dimension * np.finfo(float).eps]
    if not live:
        return None
    w = project(fit_list.withColumn("id", F.lit(0)), fitted, "id", "x").select(*(F.get("whitened", F.lit(i)).alias(f"w{i}") for i in live))
    pairs = [(i, j) for a, i in enumerate(live) for j in live[a:]]
    row = w.agg(*(F.sum(f"w{i}") for i in live), *(F.expr(f"sum(w{i} * w{j})") for i, j in pairs)).first()
    # The columns are centred already; what rounding leaves of their means is taken off.
    mean = {i: row[k] / fitted.n for k, i in enumerate(live)}
    return max(abs(s / fitted.n - mean[i] * mean[j] - (i == j)) for (i, j), s in zip(pairs, row[len(live) :]))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every vector, fitted on the distinct ones.

    Returns a row for each remaining vector and component: ``id_col``,
    ``component`` (int from 1, by falling variance), ``n`` (long, vectors in
    the fit list), ``deviation`` (decimal, exact), ``whitened``, ``explained``
    and ``identity_error`` (doubles).
    """
    numbers = whole_numbers(vectors.select(id_col, vector_col), vector_col)
    every = stored(numbers.select(F.col(vector_col).alias("x")).distinct())
    usual = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 1
    fit_list = every.where(F.size("x") == d)
    fitted = fit(fit_list, components)
    if fitted is None:
        fitted = Whitening(1, (0,) * d, np.eye(d)[:, :components], np.zeros(min(d, components)), 0.0)
    error = identity_error(fit_list, fitted)
    drop_stored(every)
    each = project(numbers.where(F.size(vector_col) == d), fitted, id_col, vector_col)

    def constant(values: list) -> Column:
        return F.array(*(F.lit(v).cast("double") for v in values))

    out = each.select(id_col, "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return out.select(
        id_col,
        (F.col("component") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(constant(fitted.explained), F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def digests(whitened: DataFrame) -> DataFrame:
    """The query's columns: ``deviation`` as a long, null beyond 64 bits."""
    return whitened.withColumn("deviation", F.col("deviation").try_cast("bigint"))


#: Base columns, one row for each vector.
BASE_ORACLE = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM v),
m AS (SELECT count(*) AS n FROM f),
c AS (SELECT i, sum(x[i]) AS s FROM f, range(1, 65) AS r(i) GROUP BY i)
SELECT vec_id, n, CAST(sum((n * x[i] - s) * (n * x[i] - s)) AS BIGINT) AS deviation FROM v, c, m GROUP BY vec_id, n"""
