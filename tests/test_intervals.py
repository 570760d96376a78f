"""Interval joins by dyadic covers against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation as C


def test_cover_is_exact_and_short(spark):
    """Every integer of a range once, no other, with two nodes a level at most; negative bounds, single cells and a range of 2 ** 40 cells."""
    rng = random.Random(1)
    ranges = [(0, 0), (5, 5), (-3, 4), (-8, -1), (0, 7), (1, 62), (-1, 0)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(-400, 400) for _ in range(60))]
    got = spark.createDataFrame(ranges + [(3, 2**40)], "low long, high long").withColumn("c", C.dyadic_cover(F.col("low"), F.col("high"))).collect()
    for r in got:
        nodes = [(n["level"], n["node"]) for n in r["c"]]
        assert len(nodes) <= 2 * (r["high"] - r["low"] + 1).bit_length() and len(set(nodes)) == len(nodes)
        if r["high"] < 2**39:
            held = [i for level, node in nodes for i in range(node << level, (node + 1) << level)]
            assert sorted(held) == list(range(r["low"], r["high"] + 1))
    assert sum((1 << n["level"]) for n in got[-1]["c"]) == 2**40 - 2


@pytest.fixture(scope="module")
def sides(spark):
    """Short intervals, one over the whole range, an empty and an inverted one, nulls, repeated rows, points on borders."""
    rng = random.Random(2)
    points = [(rng.choice("ab"), i, rng.choice([rng.uniform(-50, 1000), float(rng.randrange(1000))])) for i in range(400)] + [("a", 900, None), (None, 901, 3.0)]
    spans = [(rng.choice("ab"), i, a := float(rng.randrange(900)), a + rng.choice([0.0, -2.0, 0.5, 7.0, 90.0])) for i in range(60)]
    spans += [("a", 100, -1e9, 1e9), ("b", 101, None, 4.0), ("b", 102, 5.0, None), spans[0]]
    return points + points[:5], spans, spark.createDataFrame(points + points[:5], "k string, pid long, f double"), spark.createDataFrame(spans, "k string, sid long, a double, b double")


@pytest.mark.parametrize("width", [0.01, 1.0, 1e6])
def test_joins_equal_all_pairs(sides, width):
    points, spans, p, s = sides
    pairs = [(x, y) for x in points for y in spans if x[0] == y[0] and None not in (x[0], x[2], y[2], y[3])]
    got = C.range_join(p, s, "f", "a", "b", "k", width).select("pid", "sid").collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x, y in pairs if y[2] <= x[2] < y[3])
    inside = [x for x in points if any(a == x and y[2] < x[2] < y[3] for a, y in pairs)]
    assert sorted(r["pid"] for r in C.covered_points(p, s, "f", "a", "b", "k", width).collect()) == sorted(x[1] for x in inside)


def test_one_interval_over_everything_makes_few_rows(spark):
    """A range of 10 ** 12 cells is a few dozen rows; no task holds more than its cover."""
    wide = spark.createDataFrame([("a", 0.0, 1e12)], "k string, a double, b double")
    assert wide.select(F.explode(C.dyadic_cover(F.floor("a"), F.floor("b")))).count() <= 80
    points = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * 1e9 - 5).alias("f"))
    assert C.range_join(points, wide, "f", "a", "b", "k", 1.0).count() == 999
    assert C.covered_points(points, wide.limit(0), "f", "a", "b", "k", 1.0).count() == 0
