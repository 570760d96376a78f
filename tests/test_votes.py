"""Majorities of groups of thousands of rows, and how their work is dealt."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M


def test_win_probabilities_of_thousands_of_draws():
    start = time.time()
    chances = M.win_probabilities((800, 790, 810, 805, 795), 4000)
    assert sum(chances) == pytest.approx(1, abs=1e-9) and time.time() - start < 20
    assert M.win_probabilities((2, 1), 2) == pytest.approx([4 / 9 + 2 / 9, 1 / 9 + 2 / 9], abs=1e-12)


def test_votes_are_dealt_over_tasks(spark):
    rows = spark.range(0, 400).select((F.col("id") % 40).alias("g"), (F.col("id") % 3).alias("vote"), F.col("id").alias("x"))
    tasks = M.majority_moments(rows, ["g"], "vote", "x").select("g", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) > 4


def test_worst_mirrors_best(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 5, 5, 7)] + [("b", 3.0)], "g string, x double")
    got = {(r.n, r.metric): (r["mean"], r["std"]) for r in M.extreme_moments(rows, ["g"], "x", rows_per_task=1).collect()}
    back = {(r.n, r.metric): (r["mean"], r["std"]) for r in M.extreme_moments(rows.withColumn("x", -F.col("x")), ["g"], "x").collect()}
    assert set(got) == {(n, m) for n in (2, 4, 6) for m in ("best", "worst")}
    for n in (2, 4, 6):
        assert got[n, "best"][0] == pytest.approx(-back[n, "worst"][0]) and got[n, "worst"][1] == pytest.approx(back[n, "best"][1])
