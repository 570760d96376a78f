"""Token-level operators on exploded rows (row_id, pos, mask, ...): masked statistics, losses, KL, token-axis folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.registry import Registry

POLICY_LOSSES = Registry("policy loss")


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(F.when(mask, x).otherwise(0.0))


def masked_mean(x: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(x, mask) / (F.count_if(mask) + eps)


def masked_var(x: str, mask: str) -> Column:
    """Unbiased variance over the mask."""
    return F.var_samp(F.when(F.col(mask), F.col(x)))


def whiten(df: DataFrame, x: str, mask: str, shift_mean: bool = True) -> DataFrame:
    st = df.agg(F.avg(F.when(F.col(mask), F.col(x))).alias("_m"), masked_var(x, mask).alias("_v"))
    y = (F.col(x) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)
    return df.crossJoin(F.broadcast(st)).withColumn(x, y if shift_mean else y + F.col("_m")).drop("_m", "_v")  # one row


def agg_loss(df: DataFrame, loss: str, mask: str, mode: str, horizon: int | None = None) -> DataFrame:
    """One loss of a token loss column by the named mode."""
    per_row = df.groupBy("row_id").agg(masked_sum(F.col(loss), F.col(mask)).alias("s"), F.count_if(F.col(mask)).alias("n"))
    if mode == "token-mean":
        return df.agg((masked_sum(F.col(loss), F.col(mask)) / (F.count_if(F.col(mask)) + 1e-8)).alias("loss"))
    if mode == "seq-mean-token-sum":
        return per_row.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per_row.agg(F.avg(F.try_divide("s", "n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per_row.agg((F.sum("s") / F.lit(horizon)).alias("loss")) if horizon else per_row.crossJoin(F.broadcast(df.agg(F.max("pos").alias("_l")))).agg((F.sum("s") / (F.max("_l") + 1)).alias("loss"))
    raise ValueError(f"unknown mode {mode!r}")


def kl(lp: Column, ref: Column, kind: str) -> Column:
    """Per-token KL estimate."""
    d = lp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        r = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(r) - r - 1, F.lit(10.0)), F.lit(-10.0))
    raise NotImplementedError(kind)


@POLICY_LOSSES.register("vanilla")
def ppo_loss(old: Column, lp: Column, adv: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> tuple[Column, Column, Column]:
    """(loss, clipped, clipped below) per token, with dual clip for negative advantages."""
    ratio = F.exp(F.greatest(F.least(lp - old, F.lit(20.0)), F.lit(-20.0)))
    first, second = -adv * ratio, -adv * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    worse = F.greatest(first, second)
    capped = F.least(-adv * c, worse)
    return F.when(adv < 0, capped).otherwise(worse), second > first, (worse > -adv * c) & (adv < 0)


@POLICY_LOSSES.register("gpg")
def gpg_loss(old: Column, lp: Column, adv: Column) -> Column:
    return -lp * adv


def value_loss(pred: Column, ret: Column, value: Column, clip: float) -> Column:
    bound = F.greatest(F.least(pred, value + clip), value - clip)
    return 0.5 * F.greatest((pred - ret) ** 2, (bound - ret) ** 2)


def covariance(df: DataFrame, lp: str, adv: str, mask: str) -> DataFrame:
    """Product of deviations from the means over valid tokens."""
    m = df.agg(F.avg(F.when(F.col(mask), F.col(lp))).alias("_l"), F.avg(F.when(F.col(mask), F.col(adv))).alias("_a"))
    return df.crossJoin(F.broadcast(m)).withColumn("cov", (F.col(lp) - F.col("_l")) * (F.col(adv) - F.col("_a"))).drop("_l", "_a")  # one row


def top_share(df: DataFrame, by: str, share: float, *tie: str) -> DataFrame:
    """The max(1, floor(n * share)) rows with the largest ``by``: dense places of a range sort, not one task's limit."""
    from tessera.operators.batch import with_pos

    n = max(1, int(df.count() * share))
    down = df.withColumn("_down", -F.col(by))
    return with_pos(down, "_down", *tie, pos="_place").where(F.col("_place") < n).drop("_down", "_place")


def reverse_cumsum(x: Column) -> Column:
    """From a token to the end of its row."""
    return F.sum(x).over(Window.partitionBy("row_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing))


#: Tokens of one step of a scan: what its temporary arrays hold.
SCAN_TOKENS = 1 << 18


#: Segments up to this length are folded token by token, all at a time; longer ones by doubling.
STEPS = 512


def reverse_scan(a: np.ndarray, b: np.ndarray, ends: np.ndarray, chunk: int = SCAN_TOKENS, steps: int = STEPS) -> np.ndarray:
    """x[t] = a[t] * x[t + 1] + b[t] from the end of each segment, where x is 0; ``ends``: the index after the last of each token's segment.

    Segments of at most ``steps`` tokens go step by step from their ends, longest first, so
    that those still open are a prefix: the arithmetic of the plain fold.
    """
    out = np.empty(len(a))
    first = np.flatnonzero(np.diff(ends, prepend=-1))
    size = ends[first] - first
    short = np.flatnonzero(size <= steps)
    short = short[np.argsort(-size[short], kind="stable")]
    last, left, x = ends[first[short]] - 1, size[short], np.zeros(len(short))
    for d in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -d))  # segments longer than d
        at = last[:k] - d
        x[:k] = a[at] * x[:k] + b[at]
        out[at] = x[:k]
    if len(short) < len(size):
        long = np.repeat(size > steps, size)
        out[long] = _doubled(a[long], b[long], np.repeat(np.cumsum(size[size > steps]), size[size > steps]), chunk)
    return out


def _doubled(a: np.ndarray, b: np.ndarray, ends: np.ndarray, chunk: int) -> np.ndarray:
    """The scan by composition: affine maps compose, so after round k a token's map reaches over 2 ** k tokens of its segment.

    Chunks go from right to left, and a segment that crosses a border takes the value at it along.
    """
    out, right = np.empty(len(a)), 0.0
    for low in range((len(a) - 1) // chunk * chunk, -1, -chunk) if len(a) else ():
        high = min(len(a), low + chunk)
        f, g = a[low:high].astype(np.float64), b[low:high].astype(np.float64)
        last = np.minimum(ends[low:high], high) - low
        if ends[high - 1] > high:  # the segment goes on: its value at the border enters the chunk's last token
            g[-1] += f[-1] * right
        at, step = np.arange(high - low), 1
        longest = int((last - at).max())
        while step < longest:
            reach = np.flatnonzero(at + step < last)
            g[reach] += f[reach] * g[reach + step]
            f[reach] *= f[reach + step]
            step *= 2
        out[low:high], right = g, g[0]
    return out


def _scanned(f, *arrays: Column) -> Column:
    """``f`` of the rows' arrays as flat values and segment ends, as arrays of the same lengths; a missing array has no tokens, a missing value is 0."""

    def run(columns):
        first = columns[0]
        offsets = np.concatenate([[0], np.cumsum(first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = [c.flatten().fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
        values = f(*flat, np.repeat(offsets[1:], np.diff(offsets)))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))

    two, three = (lambda a, b: run((a, b))), (lambda a, b, c: run((a, b, c)))
    kernel = two if len(arrays) == 2 else three
    kernel.__annotations__ = dict.fromkeys(("a", "b", "c")[: len(arrays)], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(kernel, "array<double>")(*[x.cast("array<double>") for x in arrays])


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Of a row's arrays: reverse discounted sums; the state is cut to 0 after masked tokens."""

    def scan(r, m, ends):
        state = reverse_scan(gamma * m, m * r, ends)
        follows = np.append(state[1:], 0.0)
        follows[ends - 1 == np.arange(len(r))] = 0.0
        return r + gamma * follows

    return _scanned(scan, rewards, mask)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Of a row's arrays: generalised advantage estimates; masked tokens pass the state on. Two scans: the next value, then the estimates."""

    def scan(r, v, m, ends):
        value = reverse_scan(1 - m, m * v, ends)
        follows = np.append(value[1:], 0.0)
        follows[ends - 1 == np.arange(len(r))] = 0.0
        return reverse_scan(1 - m + gamma * lam * m, m * (r + gamma * follows - v), ends)

    return _scanned(scan, rewards, values, mask)


def response_mask(eos: Column) -> Column:
    """1 up to and with the first end token of a row, by running count."""
    run = F.sum(eos.cast("int")).over(Window.partitionBy("row_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return (run - eos.cast("int") == 0).cast("int")


def position_ids(mask: Column) -> Column:
    run = F.sum(mask.cast("int")).over(Window.partitionBy("row_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return ((run - 1) * mask.cast("int")).cast("long")


def adaptive_kl(kl: Column, steps: float, target: float, horizon: float, init: float) -> Column:
    """Coefficient after the KL values of a column: each multiplies it by a factor that does not depend on it, so their order does not count. An aggregate."""
    return F.coalesce(F.product(1 + F.greatest(F.least(kl / target - 1, F.lit(0.2)), F.lit(-0.2)) * steps / horizon), F.lit(1.0)) * init


def entropy_of_logits(logits: Column) -> Column:
    """log-sum-exp less the expected logit."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    e = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x)
    return F.log(z) + top - e / z


def dpo_loss(margin: Column, beta: float, smoothing: float = 0.0, kind: str = "sigmoid") -> Column:
    """Preference loss of (policy margin - reference margin)."""
    if kind == "ipo":
        return (margin - 1 / (2 * beta)) ** 2
    sp = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # noqa: E731  softplus
    return (1 - smoothing) * sp(-beta * margin) + smoothing * sp(beta * margin)


def overlong_penalty(length: Column, maximum: int, buffer: int, factor: float = 1.0) -> Column:
    return F.least(-(length - (maximum - buffer)) / buffer * factor, F.lit(0.0))
