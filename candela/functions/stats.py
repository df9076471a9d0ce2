"""Statistics as column expressions: normal tail, Wilson interval, average ranks, rate blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Coefficients of Hart's rational approximation of the normal tail (1968, in West's form of 2005).
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_tail(x: Column) -> Column:
    """P(Z > x) for a standard normal Z."""
    a = F.abs(x)
    near = F.exp(-a * a / 2) * _horner(a, HART_TOP) / _horner(a, HART_BOTTOM)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x >= 0, tail).otherwise(1 - tail)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval as shares in 0..1; (0, 1) for n = 0."""
    n = n.cast("double")
    p = hits / F.nullif(n, F.lit(0.0))
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = (F.greatest(F.lit(0.0), (middle - width) / scale), F.least(F.lit(1.0), (middle + width) / scale))
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def average_rank(x: Column, *by: str | Column) -> Column:
    """Rank with ties averaged, within the groups."""
    same = Window.partitionBy(*by, x)
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(same) - 1) / 2


def rate_block(x: Column, prefix: str) -> list[Column]:
    """Aggregates over returns in percent: n, hit rate with its Wilson bounds, mean, median and profit factor.

    Nulls are left out. The profit factor is null without losses.
    """
    n, hits = F.count(x), F.count_if(x > 0)
    low, high = wilson(hits, n)
    gain, loss = F.sum(F.when(x > 0, x)), F.sum(F.when(x < 0, -x))
    share = 100.0 * hits / F.nullif(n, F.lit(0))
    return [
        n.alias(f"{prefix}_n"), share.alias(f"{prefix}_hit"), F.when(n > 0, 100 * low).alias(f"{prefix}_low"), F.when(n > 0, 100 * high).alias(f"{prefix}_high"),
        F.avg(x).alias(f"{prefix}_mean"), F.median(x).alias(f"{prefix}_median"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias(f"{prefix}_pf"),
    ]


SQRT_10 = math.sqrt(10)
