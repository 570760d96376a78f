"""Evaluation and training metrics: grouped reductions, votes, bootstrap expectations, breakdowns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eval_by_source(df: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean of each row's scores (an array), then mean over the rows of a source."""
    row = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return df.groupBy(source).agg(F.avg(row).alias("score"))


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Maximum of names that hold "max", else minimum of those that hold "min", else mean."""
    n = F.col(name)
    return df.groupBy(name).agg(F.when(n.contains("max"), F.max(value)).when(n.contains("min"), F.min(value)).otherwise(F.avg(value)).alias(value))


def summary(x: Column, prefix: str) -> list[Column]:
    return [F.avg(x).alias(f"{prefix}_mean"), F.max(x).alias(f"{prefix}_max"), F.min(x).alias(f"{prefix}_min")]


def explained_variance(ret: str, value: str) -> Column:
    return 1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)


def valid_only(x: str, prefix: str) -> list[Column]:
    """Statistics of a metric whose negative values mean missing."""
    ok = F.when(F.col(x) >= 0, F.col(x))
    return [F.avg(ok).alias(f"{prefix}_mean"), F.max(ok).alias(f"{prefix}_max"), F.min(ok).alias(f"{prefix}_min"), F.count(ok).alias(f"{prefix}_valid"), F.count("*").alias(f"{prefix}_total")]


def expected_extreme(df: DataFrame, group: Sequence[str], x: str, n: int, best: bool = True) -> DataFrame:
    """Exact mean of the best (worst) of ``n`` draws with replacement from each group: what a bootstrap estimates."""
    w = Window.partitionBy(*group).orderBy(F.asc(x) if best else F.desc(x))
    k, m = F.row_number().over(w), F.count("*").over(Window.partitionBy(*group))
    p = F.pow(k / m, F.lit(n)) - F.pow((k - 1) / m, F.lit(n))
    return df.withColumn("_p", p).groupBy(*group).agg(F.sum(F.col("_p") * F.col(x)).alias("value"))


def bootstrap(df: DataFrame, group: str, x: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(group, best, worst): means and stds over seeded draws with replacement, for parity with sampled estimates."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        values, rng = pdf[x].to_numpy(), np.random.RandomState(seed)
        picked = values[rng.choice(len(values), (draws, n), replace=True)]
        top, low = picked.max(1), picked.min(1)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "best_mean": [top.mean()], "best_std": [top.std()], "worst_mean": [low.mean()], "worst_std": [low.std()]})

    kind = dict(df.dtypes)[group]
    return df.select(group, x).groupBy(group).applyInPandas(run, f"{group} {kind}, best_mean double, best_std double, worst_mean double, worst_std double")


def majority_value(df: DataFrame, group: Sequence[str], vote: str, value: str, order: str) -> DataFrame:
    """Value of the first row of each group's most frequent vote; the vote seen first wins a tie."""
    v = df.groupBy(*group, vote).agg(F.count("*").alias("_n"), F.min(order).alias("_at"), F.min_by(value, order).alias("value"))
    return v.groupBy(*group).agg(F.max_by("value", F.struct("_n", -F.col("_at"))).alias("value"))


def ladder(size: Column) -> Column:
    """2, 4, 8, .. below ``size``, then ``size``; nothing for a size of one."""
    doubling = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.expr("1L") * F.pow(F.lit(2.0), i).cast("long")), lambda n: n < size)
    return F.when(size > 1, F.concat(doubling, F.array(size.cast("long")))).otherwise(F.array().cast("array<long>"))


def extreme_moments(df: DataFrame, group: Sequence[str], x: str, rows_per_task: int = 500_000) -> DataFrame:
    """(group, n, metric, mean, std) of the best and worst of n draws with replacement, n along the ladder of each group's size: exact, by order statistics.

    Groups are sorted once, dealt to as many tasks as their rows ask for, so that a task's memory does not grow with the table.
    """
    every = Window.partitionBy(*group)
    ranked = df.select(*group, F.col(x).cast("double").alias("_x"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranked.count() // rows_per_task))
    ranked = ranked.repartition(parts, *group).withColumns({"_m": F.count("*").over(every), "_up": F.row_number().over(every.orderBy("_x"))})
    ranked = ranked.withColumn("_down", F.col("_m") - F.col("_up") + 1)  # rows of one value may change places
    each = ranked.withColumn("n", F.explode(ladder(F.col("_m"))))
    out = []
    for place in ("_up", "_down"):
        p = F.pow(F.col(place) / F.col("_m"), F.col("n")) - F.pow((F.col(place) - 1) / F.col("_m"), F.col("n"))
        out += [F.sum(p * F.col("_x")), F.sum(p * F.col("_x") * F.col("_x"))]
    sums = each.groupBy(*group, "n").agg(*[c.alias(a) for c, a in zip(out, ("_b1", "_b2", "_w1", "_w2"))])
    row = lambda name, first, second: F.struct(F.lit(name).alias("metric"), F.col(first).alias("mean"), F.sqrt(F.greatest(F.col(second) - F.col(first) ** 2, F.lit(0.0))).alias("std"))
    return sums.select(*group, "n", F.inline(F.array(row("best", "_b1", "_b2"), row("worst", "_w1", "_w2"))))


def win_probabilities(counts: Sequence[int], n: int, block: int = 64) -> list[float]:
    """Of votes with these counts, the probability of each to be the most frequent among ``n`` draws with replacement; a tie goes to the vote drawn first.

    Counts of the draws are independent Poisson numbers given their sum.  If the winner has
    c draws, each other vote has fewer, or c as well: t such ties are equally likely to have
    come first, and 1 / (t + 1) is the integral of u ** t over [0, 1], which a Gauss rule
    gives exactly.  So the chance is the coefficient of z ** n in a product of one polynomial
    for each vote, read off its values on the unit circle: the sum of all draws is nearly
    Poisson with mean n, and what lies ``size`` or more from n, which would be added to it,
    is below 1e-50.  Winner's counts of a chance below 1e-30 add nothing to a double.
    """
    total, k = sum(counts), len(counts)
    kinds, many = np.unique(np.asarray(counts, dtype=np.int64), return_counts=True)
    j = np.arange(n + 1)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    poisson = lambda mean: np.exp(j * math.log(mean) - mean - factorials)
    laws = [poisson(n * int(a) / total) if a else (j == 0).astype(float) for a in kinds]
    likely = [np.flatnonzero(law[1:] > 1e-30) + 1 for law in laws]
    first = min((int(x[0]) for x in likely if len(x)), default=1)
    first, last = max(first, -(-n // k)), max((int(x[-1]) for x in likely if len(x)), default=n)
    size = 2 * (8 * math.isqrt(n) + 40) + 1
    t = np.arange(size // 2 + 1)
    unit = np.exp(2j * np.pi * np.arange(size) / size)
    weight = np.where(t == 0, 1.0, 2.0) / size * unit[(-n * t) % size]
    below = [(law[:first] @ unit[np.outer(np.arange(first), t) % size]) if first <= 4 * block else sum(law[i : min(i + block, first)] @ unit[np.outer(np.arange(i, min(i + block, first)), t) % size] for i in range(0, first, block)) for law in laws]
    won = np.zeros(len(kinds))
    for low in range(first, last + 1, block):
        c = np.arange(low, min(low + block, last + 1))
        powers = unit[np.outer(c, t) % size]
        here = [law[c, None] * powers for law in laws]
        upto = [b + np.cumsum(h, axis=0) - h for b, h in zip(below, here)]
        points = min(k - 1, n // low - 1) // 2 + 1
        for x, w in zip(*np.polynomial.legendre.leggauss(points)):
            u = (x + 1) / 2
            side = [b + u * h for b, h in zip(upto, here)]
            behind = [np.ones(1)]  # products of the kinds after each one
            for s, m in zip(side[:0:-1], many[:0:-1]):
                behind.append(behind[-1] * s ** int(m))
            ahead = np.ones(1)
            for i, (s, m) in enumerate(zip(side, many)):
                others = ahead * behind[len(kinds) - 1 - i] * s ** int(m - 1)
                won[i] += w / 2 * float((others * here[i] @ weight).real.sum())
                ahead = ahead * s ** int(m)
        below = [b + h.sum(axis=0) for b, h in zip(below, here)]
    won /= math.exp(n * math.log(n) - n - factorials[n])
    chance = dict(zip(kinds.tolist(), won.tolist()))
    return [chance[int(a)] for a in counts]


def majority_moments(df: DataFrame, group: Sequence[str], vote: str, x: str, sizes: Column | None = None) -> DataFrame:
    """(group, n, metric, mean, std) of the value of the first draw of the most frequent vote among n draws with replacement.

    ``sizes``: the values of n, by default the ladder of each group's size.  Draws of one vote
    have its mean and its mean square; a group is one row of its votes' counts.  A null vote is a vote.
    """
    def chances(counts: pd.Series, n: pd.Series) -> pd.Series:
        known = cache(win_probabilities)
        return pd.Series([known(tuple(int(v) for v in c), int(i)) for c, i in zip(counts, n)])

    value = F.col(x).cast("double")
    votes = df.groupBy(*group, vote).agg(F.count("*").alias("count"), F.avg(value).alias("first"), F.avg(value * value).alias("second"))
    votes = votes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("count", "first", "second"))).alias("_votes"), F.sum("count").alias("_m"))
    each = votes.withColumn("n", F.explode(ladder(F.col("_m")) if sizes is None else sizes))
    spark = df.sparkSession  # few bytes and long work: dealt by number, as Spark would put small partitions into one task
    each = each.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *group, "n")
    each = each.withColumn("_p", F.pandas_udf(chances, "array<double>")(F.col("_votes")["count"], "n"))
    moment = lambda name: F.aggregate(F.zip_with("_votes", "_p", lambda v, p: v[name] * p), F.lit(0.0), lambda a, b: a + b)
    return each.select(*group, "n", F.lit("maj").alias("metric"), moment("first").alias("mean"), F.sqrt(F.greatest(moment("second") - moment("first") ** 2, F.lit(0.0))).alias("std"))


def validation_metrics(df: DataFrame, source: str, prompt: str, variables: Sequence[str], vote: str | None = None) -> DataFrame:
    """(source, variable, metric, value): metrics of each prompt's samples, then their mean over the prompts of a source that have them.

    With N samples of a prompt: mean@N; beyond one sample std@N (population) and, for n = 2, 4,
    .. below N and N itself, mean and std of best@n, worst@n and, with ``vote``, maj@n: what
    resampling with replacement estimates, exactly.  Missing values are left out.
    """
    keep = [source, prompt] + [vote] * (vote is not None)
    long = df.select(*keep, F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("_x")) for v in variables]))).where("_x is not null")
    group = [source, prompt, "variable"]
    per = long.groupBy(*group).agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.count("*").alias("n"))
    at = lambda name: F.concat(F.lit(f"{name}@"), F.col("n").cast("string")).alias("metric")
    plain = per.select(source, "variable", at("mean"), F.col("mean").alias("value")).unionByName(per.where("n > 1").select(source, "variable", at("std"), F.col("std").alias("value")))
    drawn = extreme_moments(long, group, "_x")
    if vote is not None:
        drawn = drawn.unionByName(majority_moments(long, group, vote, "_x"))
    name = lambda part: F.concat("metric", F.lit("@"), F.col("n").cast("string"), F.lit(f"/{part}")).alias("metric")
    drawn = drawn.select(source, "variable", F.inline(F.array(*[F.struct(name(p), F.col(p).alias("value")) for p in ("mean", "std")])))
    return plain.unionByName(drawn).groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def breakdown(df: DataFrame, dims: Sequence[str], x: str) -> DataFrame:
    """(dimension, key, accuracy, n) of each single dimension and overall, in one pass over grouping sets."""
    sets = [[d] for d in dims] + [[]]
    g = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims]).agg(F.avg(x).alias("accuracy"), F.count("*").alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims], F.lit("overall"))
    key = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return g.select(name.alias("dimension"), key.alias("key"), "accuracy", "n")


def rollup_accuracy(df: DataFrame, domain: str, subset: str, x: str) -> DataFrame:
    """Instance-weighted accuracy of subsets, domains and overall."""
    return df.rollup(domain, subset).agg(F.avg(x).alias("accuracy"), F.count("*").alias("n"))


def first_n_scores(df: DataFrame, doc: str, order: str, vote: str, acc: str, n: int) -> DataFrame:
    """cov@n, avg@n and maj@n over the first n samples of each document."""
    w = Window.partitionBy(doc).orderBy(order)
    head = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return head.groupBy(doc).agg(F.max(acc).alias("cov"), F.avg(acc).alias("avg")).join(majority_value(head, [doc], vote, acc, order).withColumnRenamed("value", "maj"), doc)


def crossed(df: DataFrame, dims: Sequence[str], x: str, most: int = 1_000_000) -> DataFrame:
    """Every cell of the cross product of the dimensions' values, empty ones with zero; more than ``most`` cells are an error."""
    sizes = df.agg(*[F.countDistinct(d) + F.max(F.col(d).isNull().cast("int")) for d in dims]).first()
    if math.prod(n or 0 for n in sizes) > most:
        raise ValueError(f"{list(sizes)} values make more than {most} cells")
    cells = None
    for d in dims:
        v = F.broadcast(df.select(d).distinct())  # counted: at most ``most`` values
        cells = v if cells is None else cells.crossJoin(v)
    sums = df.groupBy(*dims).agg(F.count("*").alias("n"), F.sum(x).alias("total"))
    return cells.join(sums, list(dims), "left").select(*dims, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def weighted_mean(df: DataFrame, x: str, size: str) -> DataFrame:
    return df.agg((F.sum(F.col(x) * F.col(size)) / F.sum(size)).alias("value"))


def imbalance(df: DataFrame, bucket: str, size: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.sum(size).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("gap"), F.avg("s").alias("mean"))


def dense_flops(lengths: str, params: float, layers: int, heads: int, head_dim: int) -> Column:
    """Training FLOPs of a dense decoder: 6 N tokens, and attention over squared lengths."""
    return 6.0 * params * F.sum(lengths) + 12.0 * layers * heads * head_dim * F.sum(F.col(lengths) * F.col(lengths))
