"""Statistics as column expressions; Python only where Spark has no function."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def zero_divide(a: Column, b: Column) -> Column:
    """a / b; infinity where b is 0."""
    return F.when(b == 0, F.lit(INF)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def zero_log2(x: Column) -> Column:
    """log2; minus infinity at 0, infinity at infinity."""
    return F.when(x == 0, F.lit(-INF)).when(x == INF, F.lit(INF)).otherwise(F.ln(x) / math.log(2))


def log2_afc(a: Column, b: Column) -> Column:
    return zero_log2(zero_divide(a, b))


def afc(c0: Column, c1: Column, pseudo: float, alt_on_1: Column) -> Column:
    """log2((c0 + pc) / (c1 + pc)), reversed where the alternative is on haplotype 1."""
    v = F.log2((c0 + pseudo) / (c1 + pseudo))
    return F.when(alt_on_1, -v).otherwise(v)


def success(noise: Column) -> Column:
    """Probability that a connection is right at this noise rate."""
    return F.lit(1.0) - (F.lit(6.0) * noise + F.lit(10.0) * noise * noise)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Bin(n, p), 0 < p < 1: the tail on the side of ``k`` is summed
    by the recurrence of its log terms, so deep pairs neither underflow nor take long."""
    k, n = k.cast("long"), n.cast("long")
    up = F.ln(p) - F.ln(1 - p)

    def tail(first: Column, count: Column, step: Column, ratio: Column) -> Column:
        """Sum of ``count`` terms from log term ``first``; term i+1 is term i times (n-i)/(i+1) by ratio."""
        start = F.struct(F.lit(0.0).alias("s"), first.alias("t"))
        fold = lambda acc, i: F.struct((acc["s"] + F.exp(acc["t"])).alias("s"), (acc["t"] + F.ln((n - i).cast("double") / (i + 1)) + ratio).alias("t"))
        steps = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, start, lambda acc, i: F.when(i < n, fold(acc, i)).otherwise(F.struct((acc["s"] + F.exp(acc["t"])).alias("s"), acc["t"].alias("t"))))["s"]

    low = tail(n * F.ln(1 - p), k + 1, k, up)
    high = F.lit(1.0) - tail(n * F.ln(p), n - k, k, -up)
    return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).when(k < n * p, low).otherwise(F.greatest(high, F.lit(0.0)))


def conflict_p(support: Column, total: Column, noise: Column) -> Column:
    """0 without support, 1 without a conflict, else the binomial's lower tail."""
    return F.when(support == 0, F.lit(0.0)).when(support == total, F.lit(1.0)).otherwise(binomial_cdf(support, total, success(noise)))


def rank_sum(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Wilcoxon rank-sum z and two-sided p, without corrections; NaN where a side is empty."""
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return math.nan, math.nan
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    ordered = both[order]
    ranks = np.empty(len(both))
    first = np.searchsorted(ordered, both, "left")
    last = np.searchsorted(ordered, both, "right")
    ranks = (first + last + 1) / 2
    z = (ranks[:n1].sum() - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return z, math.erfc(abs(z) / math.sqrt(2))


def resampled_medians(ordered: np.ndarray, times: int, rng: np.random.Generator) -> np.ndarray:
    """Medians of ``times`` resamples with replacement of sorted values, without drawing them.

    The k-th smallest of n uniform draws is Beta(k, n - k + 1), and given it the next one
    lies the smallest of n - k uniforms further on; a draw of u stands for the value at
    rank floor(n u). So a median costs one or two draws, whatever n is.
    """
    n = len(ordered)
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, times)
    low = ordered[np.minimum((u * n).astype(np.int64), n - 1)]
    if n % 2:
        return low
    after = u + (1 - u) * rng.beta(1, n - k, times)
    return (low + ordered[np.minimum((after * n).astype(np.int64), n - 1)]) / 2


def bootstrap_median(values: np.ndarray, times: int, seed: int) -> tuple[float, float, float, float]:
    """(2.5th percentile, median, 97.5th percentile, two-sided p of 0) over resamples; only the
    median for 0 ``times``."""
    if not len(values):
        return (math.nan,) * 4
    if not times:
        return math.nan, float(np.median(values)), math.nan, math.nan
    got = resampled_medians(np.sort(values), times, np.random.default_rng(seed))
    low, high = np.percentile(got, [2.5, 97.5])
    return float(low), float(np.median(values)), float(high), 2 * min(int((got > 0).sum()), int((got < 0).sum())) / times
