"""Embedding whitening by an exact scatter in residue numbers.

An entry c becomes the whole number x = floor(scale * c).  The fit list holds each distinct
vector x once: n vectors with the sums S of their dimensions.  A task takes its vectors
as y = n * x - S, which are whole numbers centred at 0, modulo several primes, and
multiplies them as doubles: residues lie within half a prime of 0, so that BLOCK rows of
products stay below 2 ** 53 and every sum is exact.  The tasks' residues of the scatter
sum y y' are added up by Spark for each prime and pair of dimensions, and Chinese remaindering
gives the whole numbers back.  There are as many primes as the counted bound of an entry
asks for, so more rows or larger numbers only add primes.  The scatter over n ** 3 is the
covariance, rounded once; a symmetric eigensolver in double gives the components.

What reaches the driver has the size of dimensions times dimensions times primes,
whatever the number of rows.  The distinct vectors are written to the shared folder,
so that the three readings of them don't repeat the shuffle.

A row whose vector is NULL or holds NULL, NaN or an infinite entry is dropped.  Repeated
rows and keys and NULL keys each give their own rows.  An empty table, or vectors without
entries, give no rows; vectors of different lengths end the job.  A component without variance
(one distinct vector, constant or dependent dimensions) has explained 0 and whitened
NULL and isn't part of identity_error, which is NULL if there is no other component.
Further columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship

ship(__name__)

SCALE = 256
COMPONENTS = 4
#: Primes lie below this; half of it squared, BLOCK times, is 2 ** 53.
PRIME_LIMIT = 1 << 21
BLOCK = 1 << 13


def primes(at_least: int) -> list[int]:
    """The largest primes below PRIME_LIMIT, as many as their product needs to exceed ``at_least``."""
    out, n = [], PRIME_LIMIT - 1
    while prod(out) <= at_least:
        if all(n % q for q in range(3, int(n**0.5) + 1, 2)):
            out.append(n)
        n -= 2
    return out


def reconstruct(residues: dict[int, int]) -> int:
    """The whole number nearest 0 with these residues by prime."""
    whole = prod(residues)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for p, r in residues.items()) % whole
    return x - whole if 2 * x > whole else x


def whole_vectors(vector: str, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector is there with finite entries only, and its whole numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def _blocks(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The vectors of a list column as matrices of at most BLOCK rows."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    if len(sizes) and sizes[0]:
        rows = column.flatten().to_numpy().reshape(len(sizes), sizes[0])
        for at in range(0, len(rows), BLOCK):
            yield rows[at : at + BLOCK]


def _moments(vectors: DataFrame) -> list:
    """By dimension: the number of vectors, their exact sum, the least and the largest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, least, most = 0, 0, 0, None, None
        for x in (x for b in batches for x in _blocks(b.column(0))):
            if n and len(low) != x.shape[1]:
                raise ValueError("vectors of different lengths")
            n += len(x)
            low, high = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)  # no sum of halves passes 63 bits
            least = x.min(axis=0) if least is None else np.minimum(least, x.min(axis=0))
            most = x.max(axis=0) if most is None else np.maximum(most, x.max(axis=0))
        if n:
            d = len(low)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.arange(d), np.full(d, n), low, high, least, most)], ["dim", "n", "low", "high", "least", "most"])

    halves = F.sum(F.col("high").cast("decimal(38,0)")) * F.lit(Decimal(1 << 32)) + F.sum(F.col("low").cast("decimal(38,0)"))
    found = vectors.mapInArrow(run, "dim long, n long, low long, high long, least long, most long").groupBy("dim")
    out = found.agg(F.sum("n").alias("n"), halves.alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    if len({r.n for r in out}) > 1:
        raise ValueError("vectors of different lengths")
    return out


def _scatter(vectors: DataFrame, n: int, total: list[int], bound: int) -> np.ndarray:
    """sum y y' of y = n * x - total as Python's whole numbers; no entry is beyond ``bound``."""
    moduli = primes(2 * bound)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: 0 for p in moduli}
        for x in (x for b in batches for x in _blocks(b.column(0))):
            for p in moduli:
                y = (n % p * (x % p) - np.array([t % p for t in total])) % p
                y = np.where(2 * y > p, y - p, y).astype(np.float64)
                sums[p] = (sums[p] + (y.T @ y).astype(np.int64)) % p
        for p, s in sums.items():
            if not isinstance(s, int):
                i, j = np.triu_indices(len(total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(i), p), i, j, s[i, j])], ["p", "i", "j", "residue"])

    parts = vectors.mapInArrow(run, "p long, i long, j long, residue long")
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in parts.groupBy("p", "i", "j").agg(F.pmod(F.sum("residue"), F.col("p")).alias("residue")).collect():
        found.setdefault((r.i, r.j), {})[r.p] = r.residue
    out = np.zeros((len(total), len(total)), dtype=object)
    for (i, j), residues in found.items():
        out[i, j] = out[j, i] = reconstruct(residues)
    return out


def _whitener(n: int, total: list[int], vectors: np.ndarray, roots: np.ndarray):
    """x -> (x - total / n) projected on the components, over their roots."""
    quotients, rest = np.array([t // n for t in total]), np.array([t % n / n for t in total])

    def f(x: np.ndarray) -> np.ndarray:
        return ((x - quotients) - rest) @ vectors / roots

    return f


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each row that stays and component.

    Components are numbered from 1 by falling variance, their largest entry is positive.
    deviation is sum (n * x - S) ** 2 over the dimensions, exact, as decimal(38,0), NULL beyond.
    identity_error is measured: the whitened fit list's covariance against the identity.
    Runs jobs when it is called.
    """
    ok, whole = whole_vectors(vector, scale)
    rows = df.where(ok).select(F.col(key), whole.alias("_x"))
    key_type = rows.schema[0].dataType
    schema = T.StructType([
        T.StructField(key, key_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    fit = cut(rows.select("_x").distinct())
    moments = _moments(fit)
    if not moments:
        return df.sparkSession.createDataFrame([], schema)
    n, total, width = moments[0].n, [int(r.total) for r in moments], max(r.most - r.least for r in moments)
    scatter = _scatter(fit, n, total, n * (n * width) ** 2)

    # One rounding for each entry: both sides of the quotient are whole numbers.
    covariance = np.array([[s / n**3 for s in line] for line in scatter], dtype=np.float64)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    real = int((values > len(total) * np.finfo(np.float64).eps * max(values[0], 0)).sum())
    trace = sum(int(scatter[i, i]) for i in range(len(total))) / n**3
    explained = [float(v) / trace if k < real else 0.0 for k, v in enumerate(values)]
    white = _whitener(n, total, axes[:, :real], np.sqrt(values[:real]))
    error = _identity_error(fit, n, real, white) if real else None

    # A row's deviation is n * n * sum u * u - 2 * n * sum u * r + sum r * r of u = x - S // n and r = S % n.
    quotients, rest, count = np.array([t // n for t in total]), [t % n for t in total], len(values)
    plain = len(total) * max(width, 1) * max(width, n) < 1 << 62
    rests, squares = np.array(rest, dtype=np.int64 if plain else object), sum(r * r for r in rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1)):
                u = x - quotients if plain else x.astype(object) - quotients
                deviation = [n * n * a - 2 * n * b + squares for a, b in zip((u * u).sum(axis=1).tolist(), (u @ rests).tolist())]
                values = np.full((len(x), count), np.nan)
                values[:, :real] = white(x)
                flat = values.reshape(-1)
                of = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(x)).take(pa.array(of)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(of), n), pa.int64()),
                    pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)).take(pa.array(of)), pa.array(flat, pa.float64(), from_pandas=True),
                    pa.array(explained * len(x), pa.float64()), pa.array([error] * len(of), pa.float64()),
                ], schema.names)
                at += len(x)

    return rows.mapInArrow(run, schema)


def _identity_error(fit: DataFrame, n: int, real: int, white) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((real, real))
        for x in (x for b in batches for x in _blocks(b.column(0))):
            w = white(x)
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total.reshape(-1))], ["i", "j", "v"])

    sums = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.agg(F.max(F.abs(F.col("v") / n - (F.col("i") == F.col("j")).cast("double")))).first()[0]
