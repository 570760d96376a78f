"""Parsers, graders, exchange and files in Python, beside their queries' SQL."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import choices as H
from tessera.functions import latex as L
from tessera.functions import text as X
from tessera.operators import balance
from tessera.operators import dispatch as D
from tessera.operators.grouped import agreement_sums
from tessera.plans import agents as A
from tessera.sources import files, io


def naive_repetitiveness(t):
    order = sorted(t[i:] for i in range(len(t)))
    total = 0
    for a, b in zip(order, order[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        total += k
    return 2 * total / (len(t) * (len(t) + 1)) if len(t) > 1 else 0.0


def test_repetitiveness():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("abé"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(30))) * rng.choice([1, 1, 2, 3])
        assert X.repetitiveness(t) == pytest.approx(naive_repetitiveness(t))
    assert X.repetitiveness(None) == 0.0


def test_arithmetic():
    cases = {"1+2*3": 7, "(1+2)*3": 9, "-2^2": -4, "2^3^2": 512, "\\frac{1}{2}+\\frac{1}{3}": Fraction(5, 6), "1/0": None, "x+1": None, "": None, "((1)": None, "1..2": None, "2^0.5": None, "3\\cdot 4": 12}
    for text, want in cases.items():
        assert L.arithmetic(text) == want, text
    assert L.arithmetic(None) is None
    assert L.value_of_tuple("(1+1,x)") == "(1+1,x)" and L.value_of_tuple("[1/3,2]") == "[0.33,2]" and L.value_of_tuple(None) is None


def test_nulls_and_empty_replies(spark):
    df = spark.createDataFrame([(None,), ("",), ("\n \t",)], "x string")
    opts = F.array(F.lit("a"), F.lit("b"))
    columns = [
        H.parse_choice(F.col("x")), H.parse_brackets(F.col("x"), opts, opts), H.parse_periods(F.col("x"), opts, opts), H.first_letter(F.col("x")), H.parse_open(F.col("x")), H.fallback_answer(F.col("x")), H.graded_format(F.col("x")),
        H.trace_format(F.col("x")), H.judge_verdict(F.col("x")), H.crop_interval(F.col("x")), H.trace_messages(F.col("x")), H.sorted_event_lines(F.col("x")), L.final_answer(F.col("x")), L.canonical(F.col("x")), L.spoken_form(F.col("x")),
        L.boxed_score(F.col("x"), F.lit("1")), L.minerva_score(F.col("x"), F.lit("1")), L.graded_equal(F.col("x"), F.lit("1")), L.math_equal(F.col("x"), F.lit("1")), H.grounding_reward(F.col("x"), F.lit("[0,1]")),
    ]
    assert len(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()) == 3


def test_partition_lists_are_validated():
    assert D.partition_lists([3, 1, 2, 2], 2) in ([[0, 1], [2, 3]], [[2, 3], [0, 1]])
    for sizes, k, equal in (([1], 2, False), ([1, 2, 3], 2, True)):
        with pytest.raises(ValueError):
            D.partition_lists(sizes, k, equal)
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 100) for _ in range(12)]
        for k in (2, 3, 4):
            loads = [sum(sizes[i] for i in p) for p in balance.largest_differencing(sizes, k, True)]
            assert max(loads) - min(loads) <= max(sizes)


def test_agreement_equals_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(1, 40))
        s, a = rng.integers(0, 6, n) / 2, rng.integers(0, 8, n)
        pairs = [(i, j) for i in range(n) for j in range(i)]
        alike = sum(abs(a[i] - a[j]) for i, j in pairs if np.sign(s[i] - s[j]) == np.sign(a[i] - a[j]))
        got = agreement_sums(s, a)
        assert got == pytest.approx((alike, sum(abs(a[i] - a[j]) for i, j in pairs)))


def test_dispatch_needs_equal_parts(spark):
    df = spark.range(5).withColumnRenamed("id", "pos")
    with pytest.raises(ValueError):
        D.dispatch(df, "dp_compute", D.Layout(2))
    with pytest.raises(KeyError):
        D.dispatch(df, "nowhere", D.Layout(2))
    padded = D.dispatch(df, "dp_compute_proto", D.Layout(8)).groupBy("rank").count().collect()
    assert sorted((r.rank, r["count"]) for r in padded) == [(i, 1) for i in range(8)]
    few = D.dispatch(spark.range(3).withColumnRenamed("id", "pos"), "dp_compute_proto", D.Layout(8)).orderBy("rank").collect()
    assert [r.pos % 3 for r in few] == [i % 3 for i in range(8)]


def test_files(spark, tmp_path):
    source = f"{tmp_path}/a.txt"
    files.write_text(spark, source, "one é")
    copy = files.cached(spark, source, f"{tmp_path}/cache")
    assert open(copy, encoding="utf-8").read() == "one é"
    files.write_text(spark, source, "two")
    assert files.cached(spark, source, f"{tmp_path}/cache") == copy and open(copy, encoding="utf-8").read() == "one é"
    assert open(files.cached(spark, source, f"{tmp_path}/cache", again=True)).read() == "two"
    io.write_json(spark.createDataFrame([(1, "é中")], "id int, name string"), f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").first().name == "é中"


def test_loaded_functions(spark, tmp_path):
    path = f"{tmp_path}/f.py"
    files.write_text(spark, path, "SCALE = 2\n\ndef f(x, add=0):\n    return SCALE * x + add\n")
    assert A.load_function(spark, path, "f", add=1)(3) == 7
    with pytest.raises(AttributeError):
        A.load_function(spark, path, "g")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        A.load_function(spark, f"{tmp_path}/none.py", "f")


def test_agent_loop_limits():
    asks = lambda messages: "a b <tool_call>{\"name\":\"answer\",\"arguments\":{\"answer\":\"1\"}}</tool_call>"
    run = lambda **limits: A.AGENT_LOOPS.get("tool_agent")(asks, [A.AnswerTool()], **limits).run("k", "p", "1")
    tokens, mask, turns, reward = run(assistant_turns=2)
    assert len(mask) == 8 and mask == [1, 1, 1, 0, 0, 1, 1, 1] and turns == 4 and reward == 1.0
    assert run(user_turns=1)[2] == 4 and run(response=4)[1] == [1, 1, 1] and len(run(response=2)[0]) == 2
    unknown = A.Loop(lambda m: '<tool_call>{"name":"other"}</tool_call> <tool_call>broken</tool_call>', [A.AnswerTool()])
    assert unknown.run("k", "p", "1")[2] == 2


def test_interaction_ends_when_right():
    user = A.Interaction(lambda said, truth: said == truth)
    user.start("k", "4")
    assert user.respond("k", [{"role": "assistant", "content": "3"}])[0] is False
    assert user.respond("k", [{"role": "assistant", "content": "4"}]) == (True, "correct", 1.0)
    assert user.finalize("k") == 1.0 and not user.states
