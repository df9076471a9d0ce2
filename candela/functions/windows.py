"""Window specifications and column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Every series is keyed by this column and ordered by its own time column.
KEY = "symbol"


def series(by: str = "date") -> WindowSpec:
    """All rows of a symbol in time order."""
    return Window.partitionBy(KEY).orderBy(by)


def last_rows(n: int, by: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(by).rowsBetween(-(n - 1), 0)


#: Ten decimals hold a price, or a difference of prices, if they are within HELD of its value.
EXACT, HELD = "decimal(28,10)", 1e-9
#: Bits of the integers that stand for other values, against the largest of a symbol.
UNIT_BITS = 52
#: Ten decimals as plain integers: what a window and a series may sum to, so that doubles and longs hold them.
TENTH, QUICK_WINDOW, QUICK_SERIES = 1e10, 9e5, 9e8


def moving_means(df: DataFrame, x: Column, spans: dict[str, int], by: str = "date") -> DataFrame:
    """df with a column for each span: the mean of x over the last n rows, null before n rows have a value.

    Sums are exact, so that later comparisons don't flip on a last bit: one running sum of decimals a symbol, of which each
    window is a difference of two values, whatever its length. A symbol with values that ten decimals don't hold (tiny, 1e18
    or more) adds integers of 52 bits in a unit of its own, by its largest value. Decimals are added as longs where these hold
    the sums of the series. A window with NaN or infinity is NaN.
    """
    w = series(by)
    every, run = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in df.columns if c not in spans]
    v, held = F.col("_v"), F.col("_v").try_cast(EXACT)
    finite = F.abs(v) < float("inf")  # false for NaN, which is above all
    holds = v.isNull() | F.coalesce(F.abs(held.cast("double") - v) <= HELD * F.abs(v), F.lit(False))
    out = df.select(*names, x.cast("double").alias("_v"))
    out = out.withColumns({"_held": F.every(holds).over(every), "_top": F.max(F.when(finite, F.abs(v))).over(every), "_rows": F.count("_v").over(every)})
    top = F.coalesce("_top", F.lit(0.0))
    out = out.withColumn("_quick", F.col("_held") & (top * max(spans.values()) < QUICK_WINDOW) & (top * F.col("_rows") < QUICK_SERIES))
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(F.nullif(F.col("_top"), F.lit(0.0)))) - UNIT_BITS)
    out = out.withColumn("_unit", F.coalesce(F.when(~F.col("_held"), unit), F.lit(1.0)))
    whole = F.when(finite & ~F.col("_held"), F.rint(v / F.col("_unit")).try_cast("decimal(20,0)"))
    out = out.withColumns({
        "_q": F.sum(F.when(F.col("_quick"), F.rint(v * TENTH).cast("long"))).over(run),
        "_a": F.sum(F.when(F.col("_held") & ~F.col("_quick"), held)).over(run), "_b": F.sum(whole).over(run),
        "_n": F.count("_v").over(run), "_odd": F.count(F.when(~finite, 1)).over(run),
    })

    def over(n: int) -> Column:
        left = lambda c: F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
        total = F.when(F.col("_quick"), left("_q") / TENTH).when(F.col("_held"), left("_a").cast("double")).otherwise(left("_b").cast("double") * F.col("_unit"))
        return F.when(left("_n") >= n, F.when(left("_odd") > 0, F.lit(float("nan"))).otherwise(total / n))

    return out.select(*names, *(over(n).alias(c) for c, n in spans.items()))


def full(value: Column, x: Column, n: int, by: str = "date") -> Column:
    """value once n rows with x exist, else null."""
    return F.when(F.count(x).over(last_rows(n, by)) >= n, value)


def position(by: str = "date") -> Column:
    """0 for the first row of a symbol."""
    return F.row_number().over(series(by)) - 1


def from_end(by: str = "date") -> Column:
    """1 for the last row of a symbol."""
    return F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(by)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score_sum(*terms: tuple[Column, float]) -> Column:
    """Sum of the points whose conditions hold; a null condition doesn't."""
    total = F.lit(0.0)
    for condition, points in terms:
        total = total + F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))
    return total


def rounded(x: Column, digits: int) -> Column:
    """x to some digits, halves upwards, by plain arithmetic: every engine gives the same last digit."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits
