"""Resampling moments against full enumeration and against sampling."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M


def majority(votes, n):
    """Mean and std over all sequences of n draws from rows (vote, value): the first value of the most frequent vote, the first drawn of equals."""
    values = []
    for draw in itertools.product(votes, repeat=n):
        count = Counter(v for v, _ in draw)
        most = max(count.values())
        winner = next(v for v, _ in draw if count[v] == most)
        values.append(next(x for v, x in draw if v == winner))
    return np.mean(values), np.std(values)


@pytest.mark.parametrize("votes", ["a", "ab", "aab", "aabbc", "abcde", "aaab"])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_win_probabilities_by_enumeration(votes, n):
    counts = Counter(votes)
    wins = Counter()
    for draw in itertools.product(votes, repeat=n):
        c = Counter(draw)
        wins[next(v for v in draw if c[v] == max(c.values()))] += 1
    got = M.win_probabilities(list(counts.values()), n)
    assert got == pytest.approx([wins[v] / len(votes) ** n for v in counts])


@pytest.mark.parametrize("counts, n", [([30, 20, 50], 200), ([1] * 40, 40), ([400, 1], 1000), ([7], 9)])
def test_win_probabilities_sum_to_one(counts, n):
    got = M.win_probabilities(counts, n)
    assert sum(got) == pytest.approx(1, abs=1e-9) and all(a >= b - 1e-12 for (_, a), (_, b) in zip(*[sorted(zip(counts, got), reverse=True)[i:] for i in (0, 1)]))


def test_win_probabilities_by_sampling():
    rng = random.Random(1)
    counts, n, wins = [3, 4, 5, 1], 16, Counter()
    rows = [i for i, c in enumerate(counts) for _ in range(c)]
    for _ in range(40_000):
        draw = [rng.choice(rows) for _ in range(n)]
        c = Counter(draw)
        wins[next(v for v in draw if c[v] == max(c.values()))] += 1
    assert M.win_probabilities(counts, n) == pytest.approx([wins[i] / 40_000 for i in range(4)], abs=0.012)


def test_ladder(spark):
    got = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9)], "m long").select("m", M.ladder(F.col("m")).alias("n")).collect()
    assert {r["m"]: r["n"] for r in got} == {1: [], 2: [2], 3: [2, 3], 4: [2, 4], 5: [2, 4, 5], 8: [2, 4, 8], 9: [2, 4, 8, 9]}


def test_validation_metrics_equal_enumeration(spark):
    """Prompts of 1 to 5 samples; a null vote is a vote, a missing value none; each metric is averaged over the prompts that have it."""
    rng = random.Random(2)
    rows = [(s, p, rng.choice([None, "x", "y", "z"]), rng.choice([0.0, 1.0, 0.5]), rng.randrange(9)) for s in "ab" for p in range(6) for _ in range(1 + p % 5)]
    df = spark.createDataFrame(rows + [("a", 0, "x", None, None)], "source string, prompt int, vote string, acc double, len int")
    want = {}
    for s in "ab":
        for name, at in (("acc", 3), ("len", 4)):
            for p in range(6):
                held = [(r[2], float(r[at])) for r in rows if r[:2] == (s, p)]
                x, size = [v for _, v in held], len(held)
                add = lambda metric, v: want.setdefault((s, name, metric), []).append(v)  # noqa: B023, E731
                add(f"mean@{size}", np.mean(x))
                if size > 1:
                    add(f"std@{size}", np.std(x))
                    for n in sorted({2, 4, size} & set(range(size + 1))):
                        draws = list(itertools.product(x, repeat=n))
                        for metric, f in (("best", max), ("worst", min)):
                            add(f"{metric}@{n}/mean", np.mean([f(d) for d in draws]))
                            add(f"{metric}@{n}/std", np.std([f(d) for d in draws]))
                        mean, std = majority(held, n)
                        add(f"maj@{n}/mean", mean)
                        add(f"maj@{n}/std", std)
    got = {(r["source"], r["variable"], r["metric"]): r["value"] for r in M.validation_metrics(df, "source", "prompt", ["acc", "len"], vote="vote").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], np.mean(v), abs_tol=1e-7) for k, v in want.items())
