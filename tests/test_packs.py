"""Evaluation packs: measures of steps by enumeration, dimensions, cascades."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.plans.packs import Dimension, Measure, Pack, evaluate, mastery, prompts


def test_mastery_of_every_pattern(spark):
    """Three parts and the whole, each right, wrong or missing."""
    units = list(itertools.product([0.0, 1.0, None], repeat=4))
    rows = [(u, s, v) for u, scores in enumerate(units) for s, v in zip(("1", "2", "3", "multi"), scores) if v is not None]
    df = spark.createDataFrame(rows, "u int, s string, reply double")
    pack = Pack("steps", lambda a: a, [F.col("reply")], mastery(["1", "2", "3"]), unit=F.col("u"), step=F.col("s"))
    got = {r.metric: (r.value, r.n) for r in evaluate(df, [pack]).collect()}
    held = [u for u in units if any(v is not None for v in u)]
    right = [[v == 1 for v in u] for u in held]
    mean = lambda f, of=lambda u: True: sum(f(u) for u in right if of(u)) / sum(of(u) for u in right)
    ig, ik = (lambda u: all(u[:3]) and not u[3]), (lambda u: not all(u[:3]) and not u[3])
    assert got["inadequate_generalization"][0] == pytest.approx(mean(ig)) and got["insufficient_knowledge"][0] == pytest.approx(mean(ik))
    for name, known in (("strict", all), ("loose", any)):
        assert got[f"complete_mastery_{name}"][0] == pytest.approx(mean(lambda u: u[3] and known(u[:3])))
        assert got[f"rote_memorization_{name}"][0] == pytest.approx(mean(lambda u: not known(u[:3]), lambda u: u[3]))
        assert got[f"score_{name}"] == (pytest.approx(mean(lambda u: 1 - 0.5 * ig(u) - ik(u) - (u[3] and not known(u[:3])))), len(held))


def test_cascade_dimensions_and_rows(spark):
    df = spark.createDataFrame([("a", None, ["x", "y"], 1), ("b", "a", ["x"], 2), (None, None, None, 3), ("a", "a", [], 4)], "first string, second string, tags array<string>, k int")
    hit = lambda a: F.coalesce(a == "a", F.lit(False))
    tags = Dimension("tag", F.col("tags"), many=True)
    packs = [
        Pack("one", hit, [F.col("first"), F.col("second")], lambda s: [Measure("acc", s, [tags]), Measure("k", F.when(s == 1, F.col("k")))], prompt=F.col("first")),
        Pack("two", hit, [F.col("second"), F.col("first")], lambda s: [Measure("acc", s)], rows=F.col("k") > 1, prompt=F.lit("p")),
    ]
    got = {(r["pack"], r["metric"], r["dimension"], r["key"]): (r["value"], r["n"]) for r in evaluate(df, packs).collect()}
    assert got == {("one", "acc", "tag", "x"): (0.5, 2), ("one", "acc", "tag", "y"): (1.0, 1), ("one", "acc", "overall", None): (0.5, 4), ("one", "k", "overall", None): (2.5, 2), ("two", "acc", "overall", None): (2 / 3, 3)}
    assert prompts(df, packs).where("pack = 'two'").count() == 3
    with pytest.raises(ValueError, match="one name"):
        evaluate(df, [packs[0], packs[0]])
