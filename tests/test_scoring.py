"""Scorer dispatch over every source, and test runs of programs."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import latex as L
from tessera.plans import code
from tessera.plans import scoring as P

FAMILIES = {
    "openai/gsm8k": [("so #### 1,234", "1234", 1.0), ("#### 3", "4", 0.0), ("1234", "1234", 0.0)],
    "lighteval/MATH": [("\\boxed{1/2}", "\\frac{1}{2}", 1.0), ("\\boxed{0.5}", "\\frac12", 1.0), ("\\boxed{2}", "3", 0.0), ("none", "3", 0.0)],
    "math_dapo": [("Answer: 1,000", "1000", 1.0), ("Answer: x = 12 cm", "12", 1.0), ("12", "12", -1.0)],
    "aime2025": [("Answer: \\frac12", "\\frac{1}{2}", 1.0), ("Answer: 5", "6", -1.0)],
    "numina_cn_k12": [("The answer is \\boxed{x+1}.", "1+x", 1.0), ("we get 7", "7", 1.0), ("answer: 33%", "0.33", 1.0), ("Answer is 8", "7", 0.0), ("", "7", 0.0)],
    "hiyouga/geometry3k": [("<think>a</think> \\boxed{2\\sqrt{2}}", "\\sqrt{8}", 1.0), ("\\boxed{3}", "3", 0.9), ("<think>a</think>\\boxed{4}", "3", 0.1)],
    "searchR1_musique": [("<answer>the Fox</answer>", "fox", 1.0), ("<answer>a wolf!</answer>", "fox\x1fWolf", 1.0), ("fox", "fox", 0.0)],
    "taco": [("```python\nprint(input()[::-1])\n```", json.dumps({"inputs": ["ab", "cd"], "outputs": ["ba", "xx"]}), 0.5)],
}


def test_every_source(spark):
    rows = [(s, r, g, w) for s, held in FAMILIES.items() for r, g, w in held]
    got = P.score(spark.createDataFrame(rows, "data_source string, response string, ground_truth string, want double")).collect()
    assert [(r.data_source, r.response, r.score) for r in got] == [(s, r, pytest.approx(w)) for s, r, _, w in rows]
    named = {x for s in P.SCORERS.items.values() for x in s.sources}
    assert len(named) == 1 + 3 + 1 + 6 + 4 + 1 + 7
    with pytest.raises(Exception, match="no scorer for source"):
        P.score(spark.createDataFrame([("unknown", "a", "b")], "data_source string, response string, ground_truth string")).collect()


@pytest.mark.parametrize(
    "program, tests, want",
    [
        ("print(sum(map(int, input().split())))", {"inputs": ["1 2", "5 5"], "outputs": ["3\n", " 10 "]}, 1.0),
        ("import sys\nfor l in sys.stdin: print(l.strip())", {"inputs": ["a\nb"], "outputs": ["a\nb"]}, 1.0),
        ("print(1/0)", {"inputs": [""], "outputs": ["1"]}, 0.0),
        ("while True: pass", {"inputs": [""], "outputs": [""]}, 0.0),
        ("x = [0] * 10**10", {"inputs": [""], "outputs": [""]}, 0.0),
        ("def f(a, b): return a + b", {"inputs": ["1\n2", "[1]\n[2]"], "outputs": ["3", "[1, 2]"], "fn_name": "f"}, 1.0),
        ("class Solution:\n    def f(self, a): return a * 2", {"inputs": [[2], [3]], "outputs": [4, 7], "fn_name": "f"}, 0.5),
        ("print(input())", {"inputs": [str(i) for i in range(14)], "outputs": [str(i) if i < 10 else "x" for i in range(14)]}, 1.0),
        ("print(1)", {"inputs": [], "outputs": []}, 0.0),
        ("import os; print(len(os.environ))", {"inputs": [""], "outputs": ["0"]}, None),
    ],
)
def test_programs(monkeypatch, program, tests, want):
    monkeypatch.setattr(code.passes, "__defaults__", (1.0,))
    got = code.pass_share(program, json.dumps(tests))
    assert got == want if want is not None else got in (0.0, 1.0)
    assert code.pass_share(None, "") is None and code.pass_share("print(1)", "{broken") == 0.0


def test_stated_answers(spark):
    cases = [("The answer is 5. So", "5"), ("Answer: x = 3", "3"), ("7 is the answer to it", "7"), ("we get \\boxed{\\frac{1}{2}} here", "\\frac{1}{2}"), ("the sum is\n12", "12"), ("12", "12"), ("", ""), (None, None)]
    got = spark.createDataFrame([(x,) for x, _ in cases], "x string").select(L.stated_answer(F.col("x")).alias("a")).collect()
    assert [r.a for r in got] == [w for _, w in cases]
