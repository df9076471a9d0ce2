"""Technical indicators. Windows are full (null before n bars) unless said otherwise; input: bars of any period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import by_series, in_order
from candela.functions.series import lagged, last_means, numbers, places
from candela.functions.windows import KEY, full, last_rows, moving_means, series

TINY = 1e-9
SPANS = (5, 10, 20, 30, 60, 120, 250)


def sma(bars: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    return moving_means(bars, F.col("close"), {f"ma_{n}": n for n in spans})


def bollinger(bars: DataFrame) -> DataFrame:
    """Bands two sample deviations around the 20-bar mean, and their width in percent of it. A ma_20 of sma() is that mean."""
    close, middle = F.col("close"), F.col("boll_mid")
    spread = 2 * full(F.stddev_samp(close).over(last_rows(20)), close, 20)
    known = "ma_20" in bars.columns
    out = bars.withColumn("boll_mid", F.col("ma_20")) if known else moving_means(bars, close, {"boll_mid": 20})
    out = out.withColumns({"boll_upper": middle + spread, "boll_lower": middle - spread})
    return out.withColumn("boll_width", (F.col("boll_upper") - F.col("boll_lower")) / F.nullif(F.col("boll_mid"), F.lit(0.0)) * 100)


def _walk():
    """The recursions of one symbol: from close and raw value to ema_12, ema_26, dea, kdj_k and kdj_d, null for null."""
    ema_12 = ema_26 = dea = None
    k, d = 50.0, 50.0
    w12, w26, w9, third, rest = 2.0 / 13, 2.0 / 27, 2.0 / 10, 1.0 / 3, 2.0 / 3
    r12, r26, r9 = 1 - w12, 1 - w26, 1 - w9

    def step(close, raw):
        nonlocal ema_12, ema_26, dea, k, d
        if close is None:
            ema_12 = ema_26 = dea = None
        elif ema_12 is None:
            ema_12, ema_26, dea = close, close, close - close
        else:
            ema_12, ema_26 = r12 * ema_12 + w12 * close, r26 * ema_26 + w26 * close
            dea = r9 * dea + w9 * (ema_12 - ema_26)
        k = rest * k + third * raw
        d = rest * d + third * k
        return ema_12, ema_26, dea, k, d

    return step


def recursions(bars: DataFrame) -> DataFrame:
    """EMA 12 and 26, MACD (dif, dea, hist) and KDJ.

    EMA: y = (1 - a) y + a x with a = 2 / (span + 1), from the first value; a null close gives null and starts anew after it.
    KDJ: k and d from 50, weight one third; the raw value is 50 before nine bars. All five are walked in one pass, row by row,
    with the steps of the SQL, so that values on a limit are the same on every engine.
    """
    low, high = full(F.min("low").over(last_rows(9)), F.col("low"), 9), full(F.max("high").over(last_rows(9)), F.col("high"), 9)
    raw = F.coalesce((F.col("close") - low) / (high - low + TINY) * 100, F.lit(50.0))
    made = ["ema_12", "ema_26", "dea", "kdj_k", "kdj_d"]
    out = bars.drop(*made).withColumns({"_x": F.col("close").cast("double"), "_rsv": raw})
    out = in_order(out, ["_x", "_rsv"], made, _walk).drop("_x", "_rsv").withColumn("dif", F.col("ema_12") - F.col("ema_26"))
    return out.withColumns({"kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d"), "hist": 2 * (F.col("dif") - F.col("dea"))})


def _recursed(close, there, raw, heads):
    """What _walk() gives for whole series side by side, a row of each at a time; ema_12, ema_26 and dea are there with close."""
    import numpy as np

    out = np.empty((5, len(close)))
    size = np.diff(np.append(heads, len(close)))
    if len(heads) < 32:  # few series: row by row
        for first, n in zip(heads, size):
            step, at = _walk(), slice(first, first + n)
            for i, (c, on, r) in enumerate(zip(close[at].tolist(), there[at].tolist(), raw[at].tolist()), first):
                out[:, i] = [np.nan if x is None else x for x in step(c if on else None, r)]
        return out
    longest = np.argsort(-size, kind="stable")
    first, size = heads[longest], size[longest]
    w12, w26, w9, third, rest = 2.0 / 13, 2.0 / 27, 2.0 / 10, 1.0 / 3, 2.0 / 3
    r12, r26, r9 = 1 - w12, 1 - w26, 1 - w9
    now = np.zeros((5, len(first)))
    now[3:] = 50.0
    going = np.zeros(len(first), bool)
    for i in range(size[0]):
        m = np.searchsorted(-size, -i)  # series with more than i rows
        at = first[:m] + i
        c, on = close[at], going[:m]
        ema_12, ema_26, dea, k, d = now[:, :m]
        ema_12[:] = np.where(on, r12 * ema_12 + w12 * c, c)
        ema_26[:] = np.where(on, r26 * ema_26 + w26 * c, c)
        dea[:] = np.where(on, r9 * dea + w9 * (ema_12 - ema_26), c - c)
        k[:] = rest * k + third * raw[at]
        d[:] = rest * d + third * k
        on[:] = there[at]
        out[:, at] = now[:, :m]
    return out


#: What day_arrays() gives, with types.
DAY_OUTPUTS = dict.fromkeys(["ema_12", "ema_26", "dea", "kdj_k", "kdj_d", *(f"ma_{n}" for n in SPANS), "tr", "atr", "_deviation", "_volume", "close_1", "close_3", "volume_3"], "double") | {"_i": "int", "_n": "bigint"}


def day_arrays(table, heads) -> list:
    """DAY_OUTPUTS of whole series, from an Arrow table of their bars and the place of each one's first row."""
    import numpy as np
    import pyarrow as pa

    (high, has_high), (low, has_low), (close, there), (volume, has_volume) = (numbers(table[c]) for c in ("high", "low", "close", "volume"))
    place = places(heads, len(close))
    lag = lambda x, on, k: lagged(x, on, place, k)
    array = lambda x, on=None: pa.array(x) if on is None else pa.array(x, mask=~on)
    with np.errstate(all="ignore"):
        lows, highs = ([lag(x, on, k) for k in range(9)] for x, on in ((low, has_low), (high, has_high)))
        nine = np.logical_and.reduce([on for _, on in lows + highs]) & there
        # NaN is above every number.
        lowest, highest = np.fmin.reduce([x for x, _ in lows]), np.maximum.reduce([x for x, _ in highs])
        raw = np.where(nine, (close - lowest) / (highest - lowest + TINY) * 100, 50.0)
        recursed = _recursed(close, there, raw, heads)
        of_close = last_means(close, there, SPANS, heads)
        before_1, has_before = lag(close, there, 1)
        ranges = ((high - low, has_high & has_low), (np.abs(high - before_1), has_high & has_before), (np.abs(low - before_1), has_low & has_before))
        has_range = np.logical_or.reduce([on for _, on in ranges])
        range_ = np.maximum.reduce([np.where(on, x, -np.inf) for x, on in ranges])
        (mean, full_),  = last_means(range_, has_range, (14,), heads)
        # The steps of stddev_samp, from the first of the twenty rows on.
        twenty = [lag(close, there, k) for k in reversed(range(20))]
        average, square = np.zeros(len(close)), np.zeros(len(close))
        for n, (x, _) in enumerate(twenty, 1):
            delta = x - average
            average = average + delta / n
            square = square + delta * (delta - delta / n)
        five = [lag(volume, has_volume, k) for k in reversed(range(1, 6))]
        total = np.zeros(len(close))
        for x, _ in five:
            total = total + x
        deviation, volume_mean = np.sqrt(square / 19), total / 5
    every = lambda rows: np.logical_and.reduce([on for _, on in rows])
    out = [array(x, there if k < 3 else None) for k, x in enumerate(recursed)] + [array(*x) for x in of_close]
    out += [array(range_, has_range), array(np.where(full_, mean, range_), has_range), array(deviation, every(twenty)), array(volume_mean, every(five))]
    out += [array(before_1, has_before), array(*lag(close, there, 3)), array(*lag(volume, has_volume, 3))]
    size = np.diff(np.append(heads, len(close)))
    return out + [array(place.astype(np.int32)), array(np.repeat(size, size))]


def day_columns(out: DataFrame) -> DataFrame:
    """The indicators that follow from DAY_OUTPUTS row by row."""
    spread = 2 * F.col("_deviation")
    out = out.withColumns({
        "dif": F.col("ema_12") - F.col("ema_26"), "kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d"), "boll_mid": F.col("ma_20"),
        "boll_upper": F.col("ma_20") + spread, "boll_lower": F.col("ma_20") - spread, "vol_ratio": F.coalesce(F.col("volume") / (F.col("_volume") + TINY), F.lit(1.0)),
    })
    width = (F.col("boll_upper") - F.col("boll_lower")) / F.nullif(F.col("boll_mid"), F.lit(0.0)) * 100
    return out.withColumns({"hist": 2 * (F.col("dif") - F.col("dea")), "boll_width": width}).drop("_deviation", "_volume")


def day_indicators(bars: DataFrame, last: int | None = None) -> DataFrame:
    """bars with the columns of recursions(), sma(), atr(), bollinger() and vol_ratio(), the place and size of their series
    (_i, _n), and of earlier rows close_1, close_3 and volume_3; of the last rows of each series alone, if their number is given.

    The same values as those operators one after the other, which are windows for each step: here one sort of the bars serves
    all, and a task takes many series at a time.
    """
    return day_columns(by_series(bars.drop(*DAY_OUTPUTS), DAY_OUTPUTS, day_arrays, last=last))


def rsi(bars: DataFrame, spans: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Simple means of gains and losses; the first bar's change counts as 0, so n bars suffice."""
    out = bars.withColumn("_delta", F.coalesce(F.col("close") - F.lag("close").over(series()), F.lit(0.0)))
    zero, priced = F.lit(0.0), F.col("close").isNotNull()
    for name, change in (("gain", F.col("_delta")), ("loss", -F.col("_delta"))):
        out = moving_means(out, F.when(priced, F.greatest(change, zero)), {f"_{name}_{n}": n for n in spans})
    strength = lambda n: F.col(f"_gain_{n}") / (F.col(f"_loss_{n}") + TINY)
    out = out.withColumns({f"rsi_{n}": 100 - 100 / (1 + strength(n)) for n in spans})
    return out.drop("_delta", *(f"_{k}_{n}" for k in ("gain", "loss") for n in spans))


def rsi_arrays(table, heads, spans: tuple[int, ...] = (6, 12, 24)) -> list:
    """rsi() of whole series, from an Arrow table of their closes: (values, there) for each span."""
    import numpy as np

    close, there = numbers(table["close"])
    before, has_before = lagged(close, there, places(heads, len(close)), 1)
    with np.errstate(all="ignore"):
        delta = np.where(there & has_before, close - before, 0.0)
        # NaN is above every number.
        gains, losses = (last_means(np.maximum(x, 0.0), there, spans, heads) for x in (delta, -delta))
        return [(100 - 100 / (1 + gain / (loss + TINY)), on & on_loss) for (gain, on), (loss, on_loss) in zip(gains, losses)]


def true_range(by: str = "date") -> Column:
    """The first bar's is high less low: greatest() skips nulls."""
    before = F.lag("close").over(series(by))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range; the true range itself before n bars."""
    out = bars.withColumn("tr", true_range())
    return moving_means(out, F.col("tr"), {"atr": n}).withColumn("atr", F.coalesce("atr", "tr"))


def volume_ma(bars: DataFrame, spans: tuple[int, ...] = (5, 10)) -> DataFrame:
    return bars.withColumns({f"vol_ma_{n}": full(F.avg("volume").over(last_rows(n)), F.col("volume"), n) for n in spans})


def vol_ratio(bars: DataFrame) -> DataFrame:
    """Volume over the mean of the five bars before; 1 before there are five."""
    w = series().rowsBetween(-5, -1)
    before = F.when(F.count("volume").over(w) >= 5, F.avg("volume").over(w))
    return bars.withColumn("vol_ratio", F.coalesce(F.col("volume") / (before + TINY), F.lit(1.0)))


def period_vol_ratio(bars: DataFrame) -> DataFrame:
    """Volume over the mean of five bars with its own, two digits (index panels)."""
    five = full(F.avg("volume").over(last_rows(5)), F.col("volume"), 5)
    return bars.withColumn("period_vol_ratio", F.round(F.col("volume") / (five + TINY), 2))


def run_length(df: DataFrame, condition: Column, name: str, most: int | None = None) -> DataFrame:
    """name: rows up to this one for which the condition has held without a break; a null condition breaks."""
    broken = F.sum(F.when(condition, 0).otherwise(1)).over(series().rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_holds", F.when(condition, 1).otherwise(0)).withColumn("_island", broken)
    held = F.sum("_holds").over(Window.partitionBy(KEY, "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    value = held if most is None else F.least(held, F.lit(most))
    return out.withColumn(name, value.cast("int")).drop("_holds", "_island")


def consecutive_runs(bars: DataFrame) -> DataFrame:
    """down_run and up_run: consecutive lower and higher closes."""
    out = bars.withColumn("_before", F.lag("close").over(series()))
    out = run_length(out, F.col("close") < F.col("_before"), "down_run")
    return run_length(out, F.col("close") > F.col("_before"), "up_run").drop("_before")


def heavy_volume_run(bars: DataFrame) -> DataFrame:
    """Consecutive bars with a vol_ratio above 1.5, five at most; bars need vol_ratio."""
    return run_length(bars, F.col("vol_ratio") > 1.5, "heavy_run", most=5)


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator, as later operators expect them. Symbols with fewer than 10 bars give no rows."""
    out = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY))).where(F.col("_n") >= 10).drop("_n")
    for step in (recursions, sma, bollinger, rsi, atr, volume_ma, vol_ratio, period_vol_ratio, heavy_volume_run):
        out = step(out)
    return out
