"""Generated sources, generation in batches, limiter, boxes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import choices as H
from tessera.plans.agents import Scored, generate_batches
from tessera.streaming.stateful import throttled


def test_generated_sources(spark, sf):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    math_rows = catalog.QUERIES["s15_generated_rows"](spark, sf).collect()
    assert {r["id"] for r in math_rows} == ids
    for r in math_rows:
        a, b, c = map(int, re.fullmatch(r"\((\d) \+ (\d)\) \* (\d)", r["prompt"]).groups())
        assert (a + b) * c == r["answer"]
    for r in catalog.QUERIES["s16_char_count_source"](spark, sf).collect():
        letter, word = re.fullmatch(r"How many (\w) are there in (\w+)\?", r["prompt"]).groups()
        assert r["response"] == f"\\boxed{{{word.count(letter)}}}"


def test_generation_in_batches(spark):
    df = spark.range(25).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).repartition(3)
    sizes = lambda texts: [f"{t}/{len(texts)}" for t in texts]
    out = generate_batches(df, sizes, "id", "prompt", 3, 4).collect()
    assert len(out) == 25 and all(r.responses == [f"p{r.id}/4"] * 3 for r in out)
    assert generate_batches(df.limit(0), sizes, "id", "prompt", 3, 4).count() == 0


def test_limiter(spark):
    """Bursts, rests and requests of several units, against the bucket by hand."""
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, float(t), float(rng.choice([1, 2]))) for i, t in enumerate(sorted(rng.randrange(200) for _ in range(80)))]
    got = {r["i"]: r["admitted"] for r in throttled(spark.createDataFrame(rows, "k string, i int, at double, u double"), "k", "at", "i", 30, 5, "u").collect()}
    for k in "ab":
        level, seen, now = 5.0, None, 0.0
        for _, i, at, units in [r for r in rows if r[0] == k]:
            now = max(now, at)
            level = 5.0 if seen is None else min(5.0, level + (now - seen) / 2)
            if level < units:
                now += (units - level) * 2
                level = units
            level, seen = level - units, now
            assert got[i] == pytest.approx(now, abs=1e-6)


def test_fitted_boxes(spark):
    cases = [((10, 10, 60, 60), (10, 10, 60, 60)), ((-5, -5, 50, 50), (0, 0, 50, 50)), ((90, 90, 200, 200), None), ((50, 10, 40, 60), None), ((0, 0, 20, 90), None), ((0, 0, 100, 0), None), ((None, 0, 50, 50), None)]
    df = spark.createDataFrame([(*b, i) for i, (b, _) in enumerate(cases)], "l int, t int, r int, b int, i int")
    box = lambda **k: H.fitted_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.lit(100), F.lit(100), **k)
    got = {r["i"]: r["x"] and tuple(r["x"]) for r in df.select("i", box().alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    grown = {r["i"]: r["x"] and tuple(r["x"]) for r in df.select("i", box(small=9).alias("x")).collect()}
    left, right = grown[4][0], grown[4][2]
    assert right - left >= 28 and (left + right) / 2 == 10 and grown[4][3] - grown[4][1] == 2 * math.ceil(90 * 28 / 20 / 2)


def test_scored_state():
    held = Scored("x", penalty=0.1, enough=0.5)
    assert [held.rate(v) for v in (0.0, 0.4, 0.4, 0.6)] == [(-0.1, False), (0.0, False), (-0.1, False), (0.0, True)] and held.last == 0.6


def test_composite_rewards(spark):
    call = "<think>a</think><tool_call>{'name': 'crop_video', 'arguments': {'start_time': 0, 'end_time': 10}}</tool_call>"
    rows = [(call + "<tool_response>r</tool_response><answer>b</answer>", 1.0), (call + "<answer>b</answer>", 1.0), ("<answer>b</answer>", 0.0), (call + "<tool_response>r</tool_response><answer>b</answer>", 0.0)]
    want = {"weighted": [1.0, 1.0, 0.0, 0.2], "equal": [2.0, 2.0, 0.0, 1.0], "tool": [3.0, 2.0, 0.0, 1.0], "recall": [2.5, 2.0, 0.0, 1.5], "iou": [2 + 5 / 15, 2.0, 0.0, 1 + 5 / 15]}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, acc double").orderBy("i")
    for kind, scores in want.items():
        got = df.select("i", H.composite_reward(F.col("x"), F.col("acc"), F.lit(5.0), F.lit(15.0), kind)["score"].alias("s")).collect()
        assert [r.s for r in got] == pytest.approx(scores), kind
    with pytest.raises(ValueError):
        H.composite_reward(F.col("x"), F.col("acc"), F.lit(0.0), F.lit(1.0), "other")


def test_summary_rounds(spark):
    """Pairs merge until one block is left; a failing call costs its own block only; videos of one caption and of many."""
    from tessera.operators.video import summarize

    def model(prompt):
        lines = [x for x in prompt.splitlines() if x.startswith("Video_event")]
        if prompt.startswith("Summarize") and any("bad" in x for x in lines):
            raise RuntimeError
        return "\n".join(lines)

    rows = [("one", 0, 1.0, "c0")] + [("many", i, i + 1.0, "bad" if i == 9 else f"c{i}") for i in range(40)]
    got = {r.v: r for r in summarize(spark.createDataFrame(rows, "v string, a int, b double, c string"), "v", "a", "b", "c", model).collect()}
    assert (got["one"].summary, got["one"].segments, got["one"].groups) == ("Video_event 1 [0.0s – 1.0s]: c0", 1, 1)
    lines = got["many"].summary.splitlines()
    assert (got["many"].segments, got["many"].groups) == (40, 5)
    assert [x.rpartition(" ")[2] for x in lines] == [f"c{i}" for i in range(40) if not 8 <= i < 16]
