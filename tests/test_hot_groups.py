"""Operators whose group may be larger than a task: the same results, cut small, as in one piece."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curation as C
from tessera.operators import grouped as G
from tessera.operators import tokens as K


def agreement(rows):
    alike = total = 0.0
    for i, (u, y, x) in enumerate(rows):
        for v, b, a in rows[:i]:
            if u == v and None not in (x, y, a, b):
                total += abs(x - a)
                alike += abs(x - a) * (np.sign(y - b) == np.sign(x - a))
    return alike / total


@pytest.mark.parametrize("chunk", [1, 4, 64, 1 << 16])
def test_pairwise_agreement_of_a_hot_group(spark, chunk):
    """Ties of score, of accuracy and of both; a group over many tasks, small ones, groups of one, missing values, a null group."""
    rng = random.Random(chunk)
    rows = [("hot", rng.randrange(12) / 2, float(rng.randrange(9))) for _ in range(300)] + [(rng.choice(["a", "b", None]), rng.random(), rng.random()) for _ in range(40)]
    rows += [("one", 1.0, 2.0), ("hot", None, 1.0), ("hot", 1.0, None)]
    named = [("-" if u is None else u, y, x) for u, y, x in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, u string, y double, x double")
    assert G.pairwise_agreement(df, "u", "id", "y", "x", chunk).first()[0] == pytest.approx(agreement(named), abs=1e-9)


def test_all_events_as_one_group(spark, sf):
    rows = [("all", r["value"], float(r["event_id"] % 97)) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, u string, y double, x double").repartition(7)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    gap = np.abs(x[:, None] - x)
    want = (gap * (np.sign(y[:, None] - y) == np.sign(x[:, None] - x))).sum() / gap.sum()
    assert G.pairwise_agreement(df, "u", "id", "y", "x", 32).first()[0] == pytest.approx(want, abs=1e-9)


def recursion(captions, same):
    if len(captions) == 1:
        return [captions]
    a, b = recursion(captions[: len(captions) // 2], same), recursion(captions[len(captions) // 2 :], same)
    if same(a[-1][0], b[0][0]):
        return [*a[:-1], a[-1] + b[0], *b[1:]]
    return a + b


@pytest.mark.parametrize("leaf, share", [(2, 0.5), (2, 0.95), (3, 0.8), (16, 0.3), (4096, 0.5)])
def test_adjacent_merge_over_parts(spark, leaf, share):
    """A judge without any rule (neither symmetric nor transitive), videos of 1 to 300 rows: the events of the recursion."""

    def same(a, b):
        return zlib.crc32(f"{a}>{b}".encode()) % 100 < 100 * share

    rng = random.Random(leaf)
    videos = {f"v{n}": [f"c{rng.randrange(50)}" for _ in range(n)] for n in (1, 2, 3, 5, 8, 9, 31, 64, 300)}
    rows = [(v, i, c) for v, captions in videos.items() for i, c in enumerate(captions)]
    rng.shuffle(rows)
    out = C.merge_adjacent(spark.createDataFrame(rows, "v string, i int, c string"), "v", "i", "c", same, leaf).collect()
    got = {v: [r["captions"] for r in sorted((r for r in out if r["v"] == v), key=lambda r: r["event"])] for v in videos}
    assert got == {v: recursion(captions, same) for v, captions in videos.items()}
    assert sorted(r["event"] for r in out if r["v"] == "v300") == list(range(len(got["v300"])))


def test_adaptive_kl_is_the_chain(spark):
    values = [random.Random(1).uniform(-0.3, 0.6) for _ in range(500)]
    want = 0.2
    for v in values:
        want *= 1 + min(max(v / 0.1 - 1, -0.2), 0.2) * 32 / 1000
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    assert df.agg(K.adaptive_kl(F.col("x"), 32.0, 0.1, 1000.0, 0.2)).first()[0] == pytest.approx(want)
    assert df.limit(0).agg(K.adaptive_kl(F.col("x"), 32.0, 0.1, 1000.0, 0.2)).first()[0] == 0.2
