"""Scorer dispatch: each source's rule is one column expression, chosen by a single CASE; unknown sources are an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import choices as H
from tessera.functions import latex as L
from tessera.functions import text as X
from tessera.plans.code import code_score
from tessera.plans.registry import Registry

SCORERS = Registry("scorer")
REWARD_MANAGERS = Registry("reward manager")
READERS = Registry("reader")


@dataclass
class Scorer:
    """``rule(response, truth)`` gives a score; ``sources`` are exact names, ``prefixes`` beginnings of names; ``prepare`` makes a column of the response first."""

    rule: Callable[[Column, Column], Column]
    sources: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = field(default=())
    prepare: Callable[[Column], Column] = lambda response: response

    def applies(self, source: Column) -> Column:
        out = source.isin(*self.sources)
        for p in self.prefixes:
            out = out | F.startswith(source, F.lit(p))
        return out


def add_scorer(name: str, rule, sources=(), prefixes=(), **more) -> Scorer:
    return SCORERS.register(name)(Scorer(rule, tuple(sources), tuple(prefixes), **more))


add_scorer("number_after_marks", lambda r, g: F.coalesce((X.gsm8k_answer(r) == g).cast("double"), F.lit(0.0)), ["openai/gsm8k"])
add_scorer("boxed", L.boxed_score, ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"])
add_scorer("signed_answer", lambda r, g: L.minerva_score(r, g)["score"], ["math_dapo"], ["aime"])
add_scorer("stated_answer", L.stated_score, ["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"], prepare=L.stated_answer)
add_scorer("program", code_score, ["codecontests", "apps", "codeforces", "taco"])
add_scorer("geometry", lambda r, g: 0.9 * L.graded_box(r, F.array(g))["score"] + 0.1 * H.boxed_format(r), ["hiyouga/geometry3k"])
add_scorer("qa_exact", lambda r, g: F.coalesce(X.exact_match(X.last_answer(r), F.split(g, "\\x1f")).cast("double"), F.lit(0.0)), [f"searchR1_{x}" for x in ("nq", "triviaqa", "popqa", "hotpotqa", "2wikimultihopqa", "musique", "bamboogle")])


def score(df: DataFrame, source: str = "data_source", response: str = "response", truth: str = "ground_truth", out: str = "score") -> DataFrame:
    s, expr = F.col(source), None
    scorers, columns = list(SCORERS.items.values()), df.columns
    given = {}
    for i, scorer in enumerate(scorers):
        mine = scorer.applies(s)
        given |= {f"_r{i}": scorer.prepare(F.when(mine, F.col(response))), f"_g{i}": F.when(mine, F.col(truth))}
    df = X.staged(df, given)
    for i, scorer in enumerate(scorers):  # a Python rule runs before CASE: other sources' rows are null to it
        value = scorer.rule(F.col(f"_r{i}"), F.col(f"_g{i}")).cast("double")
        expr = F.when(scorer.applies(s), value) if expr is None else expr.when(scorer.applies(s), value)
    return df.withColumn(out, expr.otherwise(F.raise_error(F.concat(F.lit("no scorer for source "), s)).cast("double"))).select(*columns, out)


def score_batch(df: DataFrame, f: Callable, columns: list[str], out: str = "score", seconds: float | None = None) -> DataFrame:
    """A Python scorer over lists of rows, in Arrow batches; a row that fails or takes too long scores 0."""

    def run(*series):
        import signal
        import threading

        import pandas as pd

        timed = seconds is not None
        if timed and threading.current_thread() is not threading.main_thread():
            raise RuntimeError("a time limit needs a worker's main thread")

        def one(args):
            try:
                if timed:
                    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError()))
                    signal.setitimer(signal.ITIMER_REAL, seconds)
                return float(f(*args))
            except Exception:  # noqa: BLE001  a failing scorer is a score of 0
                return 0.0
            finally:
                if timed:
                    signal.setitimer(signal.ITIMER_REAL, 0)

        return pd.Series([one(a) for a in zip(*series)], dtype="float64")

    return df.withColumn(out, F.pandas_udf(run, "double")(*columns))


@REWARD_MANAGERS.register("naive")
def naive_manager(df: DataFrame, **_) -> DataFrame:
    return score(df)


@REWARD_MANAGERS.register("batch")
def batch_manager(df: DataFrame, f: Callable, **_) -> DataFrame:
    """A Python scorer of (source, response, truth), in Arrow batches."""
    return score_batch(df, f, ["data_source", "response", "ground_truth"])


@REWARD_MANAGERS.register("prime")
def prime_manager(df: DataFrame, f: Callable, seconds: float = 300.0, **_) -> DataFrame:
    """As ``batch``, with a time limit for each row; a row that fails or takes longer scores 0."""
    return score_batch(df, f, ["data_source", "response", "ground_truth"], seconds=seconds)


@REWARD_MANAGERS.register("dapo")
def dapo_manager(df: DataFrame, length: str = "length", maximum: int = 16384, buffer: int = 4096, factor: float = 1.0) -> DataFrame:
    from tessera.operators.tokens import overlong_penalty

    return score(df).withColumn("score", F.col("score") + overlong_penalty(F.col(length), maximum, buffer, factor))


@dataclass
class EvalTask:
    """A declarative evaluation: prompt and truth columns, a scorer, and named aggregations of its scores."""

    name: str
    prompt: Callable[[], Column]
    scorer: str
    metrics: dict[str, Callable[[str], Column]] = field(default_factory=lambda: {"acc": F.avg})
    rows: Callable[[DataFrame], DataFrame] = lambda df: df

    def prompts(self, df: DataFrame) -> DataFrame:
        return self.rows(df).withColumn("prompt_text", self.prompt())

    def evaluate(self, df: DataFrame, response: str, truth: str, by: list[str] | None = None) -> DataFrame:
        rule = SCORERS.get(self.scorer).rule
        scored = X.staged(df, {"_r": SCORERS.get(self.scorer).prepare(F.col(response))}).withColumn("_s", rule(F.col("_r"), F.col(truth)))
        return scored.groupBy(*(by or [])).agg(*[m("_s").alias(k) for k, m in self.metrics.items()])
