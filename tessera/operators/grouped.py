"""Group-relative statistics: advantages over rollouts of a prompt, group filters, pairings and ordinals.

All work on columns: ``uid`` names the group, ``s`` the outcome score.  Standard
deviations keep the flavour of each definition (sample or population).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registry import Registry

ADVANTAGES = Registry("advantage estimator")


def _group(uid: str) -> Window:
    return Window.partitionBy(uid)


def _n(uid: str) -> Column:
    return F.count("*").over(_group(uid))


@ADVANTAGES.register("grpo")
def grpo(df: DataFrame, uid: str = "uid", s: str = "s", eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample std + eps); a group of one is compared with mean 0 and std 1; without ``by_std`` no division."""
    one = _n(uid) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(s).over(_group(uid)))
    std = F.when(one, 1.0).otherwise(F.stddev_samp(s).over(_group(uid)))
    gap = F.col(s) - mean
    return df.withColumn("advantage", gap / (std + eps) if by_std else gap)


@ADVANTAGES.register("grpo_passk")
def passk(df: DataFrame, uid: str = "uid", s: str = "s", order: str = "id", eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """The best of a group gets its lead over the second best, the others 0; a group of one is an error."""
    w = Window.partitionBy(uid).orderBy(F.desc(s), order)
    lead = F.col(s) - F.lead(s).over(w)
    std = F.stddev_samp(s).over(_group(uid)) + eps
    best = F.when(_n(uid) < 2, F.raise_error(F.lit("pass@k needs two samples or more")).cast("double")).when(F.row_number().over(w) == 1, lead / std if by_std else lead).otherwise(0.0)
    return df.withColumn("advantage", best)


@ADVANTAGES.register("rloo")
def rloo(df: DataFrame, uid: str = "uid", s: str = "s") -> DataFrame:
    """Leave-one-out: n / (n - 1) * (s - mean); a group of one keeps s."""
    n = _n(uid)
    return df.withColumn("advantage", F.when(n > 1, n / (n - 1) * (F.col(s) - F.avg(s).over(_group(uid)))).otherwise(F.col(s)))


@ADVANTAGES.register("opo")
def opo(df: DataFrame, uid: str = "uid", s: str = "s", length: str = "len") -> DataFrame:
    """Length-weighted baseline; a group of one gets s (baseline 0)."""
    base = F.sum(F.col(length) * F.col(s)).over(_group(uid)) / F.sum(length).over(_group(uid))
    return df.withColumn("advantage", F.col(s) - F.when(_n(uid) > 1, base).otherwise(0.0))


@ADVANTAGES.register("gpg")
def gpg(df: DataFrame, uid: str = "uid", s: str = "s", f_norm: float = 1.0) -> DataFrame:
    """alpha * (s - mean) / f_norm, alpha being rows over rows with a score other than 0."""
    total = df.agg((F.count("*") / F.greatest(F.count_if(F.col(s) != 0), F.lit(1))).alias("_alpha"))
    mean = F.when(_n(uid) == 1, 0.0).otherwise(F.avg(s).over(_group(uid)))
    return df.crossJoin(F.broadcast(total)).withColumn("advantage", F.col("_alpha") * (F.col(s) - mean) / f_norm).drop("_alpha")  # one row


@ADVANTAGES.register("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(df: DataFrame, uid: str = "uid", s: str = "s") -> DataFrame:
    """Centred in the group, then whitened over the batch; a group of one is compared with 0."""
    c = df.withColumn("_c", F.col(s) - F.when(_n(uid) == 1, 0.0).otherwise(F.avg(s).over(_group(uid))))
    stats = c.agg(F.avg("_c").alias("_m"), F.var_samp("_c").alias("_v"))
    return c.crossJoin(F.broadcast(stats)).withColumn("advantage", (F.col("_c") - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_c", "_m", "_v")  # one row


def softmean(df: DataFrame, x: str, beta: float) -> DataFrame:
    """Log-mean-exp of a column, stable; beta 0 is the mean."""
    if beta == 0:
        return df.agg(F.avg(x).alias("softmean"))
    top = df.agg(F.max(F.col(x) * beta).alias("_top"))
    return df.crossJoin(F.broadcast(top)).agg(((F.max("_top") + F.log(F.avg(F.exp(F.col(x) * beta - F.col("_top"))))) / beta).alias("softmean"))  # one row


def sppo(df: DataFrame, s: str = "s", beta: float = 1.0) -> DataFrame:
    """Scores less the soft mean of the whole batch."""
    return df.crossJoin(F.broadcast(softmean(df, s, beta))).withColumn("advantage", F.col(s) - F.col("softmean")).drop("softmean")  # one row


def keep_informative(df: DataFrame, uid: str = "uid", s: str = "s") -> DataFrame:
    """Groups whose scores differ (population std above 0), and groups of one."""
    w = _group(uid)
    return df.withColumn("_k", (F.stddev_pop(s).over(w) > 0) | (F.count("*").over(w) == 1)).where("_k").drop("_k")


def first_groups(df: DataFrame, groups: int, uid: str = "uid") -> DataFrame:
    """Rows of the first ``groups`` groups by id."""
    ids = df.select(uid).distinct().orderBy(uid).limit(groups)
    return df.join(ids, uid, "left_semi")


def band_filter(df: DataFrame, low: float, high: float, keep: int, uid: str = "uid", acc: str = "s") -> DataFrame:
    """The first ``keep`` groups, those with mean accuracy inside the band before others."""
    g = df.groupBy(uid).agg(F.avg(acc).between(low, high).alias("ok")).orderBy(F.desc("ok"), uid).limit(keep)
    return df.join(g.select(uid), uid, "left_semi")


def rollout_ordinal(df: DataFrame, index: str, order: str) -> DataFrame:
    """Ordinal that restarts whenever ``index`` changes along ``order``; islands are found inside each index value, places by a range sort."""
    from tessera.operators.batch import with_pos

    own = F.row_number().over(Window.partitionBy(index).orderBy(order))
    island = with_pos(df, order, pos="_p").withColumn("_i", F.col("_p") - own).drop("_p")
    return island.withColumn("ordinal", F.row_number().over(Window.partitionBy(index, "_i").orderBy(order)) - 1).drop("_i")


def pair_preferences(df: DataFrame, pair: str, s: str, order: str) -> DataFrame:
    """``chosen`` marks the better of each pair; the first wins a tie."""
    return df.withColumn("chosen", F.row_number().over(Window.partitionBy(pair).orderBy(F.desc(s), order)) == 1)


def agreement_sums(score: np.ndarray, acc: np.ndarray) -> tuple[float, float]:
    """Over all pairs: the accuracy gaps of those that the score orders alike, and all gaps. By halves of the accuracy order, no pair is made."""
    order = np.lexsort((score, acc))
    x, y = acc[order].astype(np.float64), score[order]
    n, alike, size = len(x), 0.0, 1
    place = np.arange(n)
    while size < n:
        block, right = place // (2 * size), place // size % 2 == 1
        o = np.lexsort((~right, y, block))  # of equal scores the right one first: it does not count the left
        left = ~right[o]
        count, total = np.cumsum(left), np.cumsum(np.where(left, x[o], 0.0))
        first = np.searchsorted(block[o], block[o], "left")
        count, total = count - np.concatenate([[0], count])[first], total - np.concatenate([[0.0], total])[first]
        alike += float((x[o] * count - total)[~left].sum())
        size *= 2
    return alike, float((x * (2 * place - n + 1)).sum())


def _agreement_across(placed: DataFrame, chunk: int) -> DataFrame:
    """(alike): gaps that pairs of different chunks add, one row for each piece of a block.

    Two places of a group differ first in some bit above a chunk's: there the left one has
    0 and the right one 1, and both share the block of the bits above.  Within a block,
    sorted by score, a right row needs the number and the sum of the left rows before it:
    running sums inside the pieces that a range sort makes, plus the totals of the pieces before.
    """
    bits = chunk.bit_length() - 1
    levels = F.when(F.col("_n") > chunk, F.sequence(F.lit(bits), F.floor(F.log2((F.col("_n") - 1).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    half = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    rows = placed.withColumn("_level", F.explode(levels)).withColumns({"_block": F.floor(F.col("_place") / (2 * half)), "_left": F.floor(F.col("_place") / half) % 2 == 0})
    keys = ["_uid", "_level", "_block"]
    rows = rows.select(*keys, "_y", "_left", "_x").repartitionByRange(*keys, "_y", "_left").withColumn("_part", F.spark_partition_id())  # of equal scores the right one first
    before = Window.partitionBy(*keys, "_part").orderBy("_y", "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_left")
    rows = rows.withColumns({"_c": F.count_if(left).over(before), "_s": F.sum(F.when(left, F.col("_x")).otherwise(0.0)).over(before)})
    right = lambda x: F.coalesce(F.sum(F.when(~left, x)), F.lit(0.0))
    pieces = rows.groupBy(*keys, "_part").agg(
        F.count_if(left).alias("n_left"), F.sum(F.when(left, F.col("_x")).otherwise(0.0)).alias("s_left"),
        F.count_if(~left).alias("n_right"), right(F.col("_x")).alias("s_right"), right(F.col("_x") * F.col("_c") - F.col("_s")).alias("own"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.withColumns({"_nl": F.coalesce(F.sum("n_left").over(earlier), F.lit(0)), "_sl": F.coalesce(F.sum("s_left").over(earlier), F.lit(0.0))})
    return sums.select((F.col("own") + F.col("s_right") * F.col("_nl") - F.col("n_right") * F.col("_sl")).alias("alike"))


def pairwise_agreement(df: DataFrame, uid: str, order: str, score: str, acc: str, chunk: int = 1 << 16) -> DataFrame:
    """Share of pairs of a group that score and accuracy order alike, weighted by the accuracy gap; over all groups.

    Rows of a group get places in the order of accuracy; pairs inside ``chunk`` places (a
    power of two) are summed in one task, others by sorts over all tasks, so a group may be
    of any size.  Rows without a score or an accuracy are left out.
    """
    from tessera.operators.batch import with_pos

    if chunk < 1 or chunk & (chunk - 1):
        raise ValueError("chunk must be a power of two")
    rows = df.select(F.col(uid).alias("_uid"), F.col(acc).cast("double").alias("_x"), F.col(score).cast("double").alias("_y"), F.col(order).alias("_o")).where("_x is not null and _y is not null")
    placed = with_pos(rows, "_uid", "_x", "_y", "_o", pos="_pos")
    sizes = placed.groupBy(F.col("_uid").alias("_u")).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    placed = placed.join(sizes, F.col("_uid").eqNullSafe(F.col("_u"))).withColumn("_place", F.col("_pos") - F.col("_first"))

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"alike": [agreement_sums(pdf["_y"].to_numpy(), pdf["_x"].to_numpy())[0]]})

    near = placed.select("_uid", F.floor(F.col("_place") / chunk).alias("_chunk"), "_x", "_y").groupBy("_uid", "_chunk").applyInPandas(run, "alike double")
    alike = near.unionByName(_agreement_across(placed, chunk)).agg(F.sum("alike").alias("alike"))
    total = placed.agg(F.sum(F.col("_x") * (2 * F.col("_place") - F.col("_n") + 1)).alias("total"))
    return alike.crossJoin(total).select(F.try_divide("alike", "total").alias("accuracy"))  # one row each


def consecutive_rloo(df: DataFrame, pos: str, n: int, s: str) -> DataFrame:
    """Leave-one-out over runs of ``n`` consecutive rows."""
    g = df.withColumn("_g", F.floor(F.col(pos) / n))
    w = Window.partitionBy("_g")
    m = F.count("*").over(w)
    return g.withColumn("advantage", F.col(s) - (F.sum(s).over(w) - F.col(s)) / F.greatest(m - 1, F.lit(1))).drop("_g")


def bon_weight(df: DataFrame, uid: str, s: str) -> DataFrame:
    """Best-of-n weight n * P(score <= own) ** (n - 1)."""
    w = Window.partitionBy(uid).orderBy(s)
    n = _n(uid)
    return df.withColumn("weight", n * F.pow(F.cume_dist().over(w), n - 1))


def resample_weights(df: DataFrame, method: str = "pow", power: float = 2.0, s: str = "s") -> DataFrame:
    """Sampling weights by score: |s| ** power, or 1 at the extremes of the batch (max_min), or 1 at the best and 0.4 elsewhere (max_random)."""
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), F.lit(power)) + 1e-8)
    ends = df.agg(F.max(s).alias("_hi"), F.min(s).alias("_lo"))
    best = F.col(s) == F.col("_hi")
    w = F.when(best | (F.col(s) == F.col("_lo")), 1.0).otherwise(0.0) if method == "max_min" else F.when(best, 1.0).otherwise(0.4)
    return df.crossJoin(F.broadcast(ends)).withColumn("weight", w + 1e-8).drop("_hi", "_lo")  # one row
