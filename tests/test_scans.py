"""Segmented reverse scans against loops, and token folds of very uneven rows."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tokens as K


@pytest.mark.parametrize("steps", [0, 4, 512])
@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 18])
def test_reverse_scan_equals_loop(chunk, steps):
    rng = np.random.default_rng(chunk)
    for sizes in ([], [1], [5], [1, 1, 1], [0, 3, 0, 17, 64, 2], [200], list(rng.integers(0, 40, 30))):
        n = int(sum(sizes))
        ends = np.repeat(np.cumsum(sizes), sizes).astype(int) if n else np.zeros(0, int)
        a, b, want = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n), np.zeros(n)
        for t in range(n - 1, -1, -1):
            want[t] = a[t] * (want[t + 1] if t + 1 < ends[t] else 0.0) + b[t]
        got = K.reverse_scan(a, b, ends, chunk, steps)
        assert np.allclose(got, want) and (steps < 512 or (got == want).all())


def gae(r, v, m, gamma, lam):
    out, following, last = [], 0.0, 0.0
    for t in reversed(range(len(r))):
        if m[t]:
            last, following = r[t] + gamma * following - v[t] + gamma * lam * last, v[t]
        out.append(last)
    return out[::-1]


def returns(r, m, gamma):
    out, state = [], 0.0
    for t in reversed(range(len(r))):
        out.append(r[t] + gamma * state)
        state = out[-1] * m[t]
    return out[::-1]


def test_folds_of_uneven_rows(spark):
    """A null and an empty row, rows of one token, and one long response among short ones."""
    rng = random.Random(1)
    rows = [None if n is None else ([rng.uniform(-1, 1) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)], [float(rng.random() < 0.7) for _ in range(n)]) for n in [None, 0, 1, 1, 3, 50, 20_000, 7, 0, 2]]
    df = spark.createDataFrame([(i, *(x or (None, None, None))) for i, x in enumerate(rows)], "i int, r array<double>, v array<double>, m array<double>").repartition(1)
    got = {r["i"]: r for r in df.select("i", K.gae(F.col("r"), F.col("v"), F.col("m"), 0.99, 0.95).alias("g"), K.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("d")).collect()}
    for i, x in enumerate(rows):
        r, v, m = x or ([], [], [])
        assert np.allclose(got[i]["g"], gae(r, v, m, 0.99, 0.95)) and np.allclose(got[i]["d"], returns(r, m, 0.9))


def test_one_long_row_among_many(spark):
    """3,000 rows of one token and one of 400,000 in one batch: memory follows the tokens (a grid of rows by the longest would take 9.6 GB)."""
    df = spark.range(3001).repartition(1).select("id", F.expr("array_repeat(1.0d, if(id = 1500, 400000, 1))").alias("r"))
    out = df.select(F.size(K.gae(F.col("r"), F.col("r"), F.col("r"), 1.0, 1.0)).alias("n"), F.col("id"))
    assert out.agg(F.sum("n")).first()[0] == 403_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4_000_000
