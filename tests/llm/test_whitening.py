"""Whitening against plain whole numbers and numpy, with every kind of trouble."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, _x string, n int"


def plain(rows):
    """n, deviations by row, and the covariance of the distinct vectors, all from whole numbers."""
    kept = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    y = [[n * x[i] - sums[i] for i in range(d)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return kept, n, sums, cov


def check(got, rows, components=4):
    kept, n, sums, cov = plain(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    assert len(got) == len(kept) * len(values)
    want = sorted((repr(k), j + 1, sum((n * c - s) ** 2 for c, s in zip(x, sums)), [c - s / n for c, s in zip(x, sums)]) for k, x in kept for j in range(len(values)))
    have = sorted((repr(r.vec_id), r.component, int(r.deviation), r.whitened, r.explained, r.n) for r in got)
    signs = {}
    for a, b in zip(want, have):
        assert a[:3] == b[:3] and b[5] == n
        j = a[1] - 1
        if values[j] > 1e-9 * values[0]:
            w = float(np.dot(a[3], axes[:, j]) / math.sqrt(values[j]))
            if abs(w) > 1e-6:
                signs.setdefault(j, math.copysign(1, w * b[3]))
            assert b[3] == pytest.approx(w * signs.get(j, 1), abs=1e-7)
            assert b[4] == pytest.approx(values[j] / np.trace(cov), rel=1e-9)
        else:
            assert b[3] is None and b[4] == 0


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, sf_dir).collect()
    check(got, rows)
    assert {type(r.deviation) for r in got} == {int} and max(r.identity_error for r in got) <= 1e-9


def test_trouble(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(40)]
    bad = [(90, None), (91, [None] * 6), (92, [float("nan")] + [0.0] * 5), (93, [float("-inf")] + [0.0] * 5)]
    rows = good + good[:7] * 30 + [(None, good[3][1]), (None, good[3][1]), (5, good[9][1])] + bad + [(94, [-0.0] * 6), (95, [0.0] * 6)]
    df = spark.createDataFrame([(k, v, "text", 7) for k, v in rows], SCHEMA).repartition(7)
    got = whitening.whiten(df).collect()
    check(got, rows)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id between 90 and 93")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).count()


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 1.0, 2.0]), (2, [2.0, 2.0, 2.0])], [(i, [float(i), 0.0, 3.0, i % 2 * 1.0, 7.0]) for i in range(9)]])
def test_without_variance(spark, rows):
    """One vector, dependent and constant dimensions: every component appears, those without variance without a value."""
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows)


@pytest.mark.parametrize("size", [1e6, 1e13])
def test_large_numbers(spark, size):
    """More primes, and whole numbers beyond 64 bits on the way."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3) * size]) for i in range(50)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


@given(st.integers(min_value=-(10**60), max_value=10**60))
def test_remainders(x):
    moduli = whitening.primes(2 * 10**60)
    assert whitening.reconstruct({p: x % p for p in moduli}) == x
