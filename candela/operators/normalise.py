"""Bar normalisation and resampling."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.windows import KEY, from_end, series

#: Code prefixes of boards with wider price limits, and of exchanges in the order of their test.
LIMIT_20, LIMIT_30 = ("300", "301", "688", "689"), ("92", "4", "8")
EXCHANGES = (("bj", ("92", "4", "8")), ("sh", ("60", "68", "90", "11", "51")))


def _starts(code: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | code.startswith(p)
    return out


def change_pct(bars: DataFrame, before: Column | None = None) -> DataFrame:
    """change_pct: percent against the close before; against the own open on a first bar or after a price of 0 or less.
    before: the close before, if at hand."""
    before = F.lag("close").over(series()) if before is None else before
    base = F.when(before > 0, before).otherwise(F.col("open"))
    return bars.withColumn("change_pct", F.round((F.col("close") - base) / F.nullif(base, F.lit(0.0)) * 100, 2))


def unit_normalise(bars: DataFrame, hand_sources: tuple[str, ...], ten_thousand_sources: tuple[str, ...] = ()) -> DataFrame:
    """Volumes in shares and amounts in units: hands are 100 shares, some sources count amounts in ten thousands."""
    return bars.withColumns({
        "volume": F.col("volume") * F.when(F.col("source").isin(*hand_sources), 100.0).otherwise(1.0),
        "amount": F.col("amount") * F.when(F.col("source").isin(*ten_thousand_sources), 1e4).otherwise(1.0),
    })


def limit_pct(code: Column, with_30: bool = False) -> Column:
    """Daily price limit in percent of a code; the 30 % board counts in the evaluation only."""
    out = F.when(_starts(code, LIMIT_20), 20.0)
    return (out.when(_starts(code, LIMIT_30), 30.0) if with_30 else out).otherwise(10.0)


def limit_flags(bars: DataFrame, limit: Column) -> DataFrame:
    """is_limit_up and is_limit_down; bars need change_pct. False on a first bar."""
    before, close, change = F.lag("close").over(series()), F.col("close"), F.col("change_pct")
    up = (change >= limit - 0.5) & (close >= before * (1 + limit / 100 - 0.001))
    down = (change <= -(limit - 0.5)) & (close <= before * (1 - limit / 100 + 0.001))
    return bars.withColumns({"is_limit_up": F.coalesce(up, F.lit(False)), "is_limit_down": F.coalesce(down, F.lit(False))})


def turnover_estimate(bars: DataFrame, float_shares: Column) -> DataFrame:
    """turnover in percent of the float, 0 if either is not above 0, and where it comes from."""
    rate = F.round(F.col("volume") / float_shares * 100, 4)
    value = F.when((F.col("volume") > 0) & (float_shares > 0), rate).otherwise(0.0)
    return bars.withColumns({"turnover": value, "turnover_status": F.lit("estimated"), "turnover_basis": F.lit("current_float_shares")})


def float_shares(market_cap: Column, price: Column) -> Column:
    """Shares from a float market cap in 1e8 units, if the result is plausible, else 5e8."""
    shares = market_cap * 1e8 / F.nullif(price, F.lit(0.0))
    return F.when((shares > 1e6) & (shares < 5e11), shares).otherwise(5e8)


def amount_estimate(bars: DataFrame) -> DataFrame:
    """amount where the source gives none: volume at the middle of open and close."""
    return bars.withColumn("amount", F.coalesce("amount", F.col("volume") * (F.col("open") + F.col("close")) / 2))


def exchange_prefix(code: Column) -> Column:
    out = None
    for name, prefixes in EXCHANGES:
        out = F.when(_starts(code, prefixes), name) if out is None else out.when(_starts(code, prefixes), name)
    return out.otherwise("sz")


def zero_value_guard(quotes: DataFrame) -> DataFrame:
    """Rows with a price; an open, high or low of 0 or less is taken from the price (high: the larger of price and open, low: the smaller)."""
    price = F.col("close")
    opened = F.when(F.col("open") > 0, F.col("open")).otherwise(price)
    high = F.when(F.col("high") > 0, F.col("high")).otherwise(F.greatest(price, opened))
    low = F.when(F.col("low") > 0, F.col("low")).otherwise(F.least(price, opened))
    return quotes.where(price > 0).withColumns({"open": opened, "high": high, "low": low})


def week_of(day: Column) -> Column:
    """The Friday that ends the week Saturday..Friday of a date."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def _resample(bars: DataFrame, bucket: Column) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("volume", "amount", "turnover") if c in bars.columns]
    return bars.groupBy(KEY, bucket.alias("date")).agg(
        F.min_by("open", bars["date"]).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", bars["date"]).alias("close"), *sums,
    )


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks labelled by their Friday; change_pct against the week before (0 on the first), no limit flags."""
    out = _resample(bars.where(F.col("close").isNotNull()), week_of(F.col("date")))
    before = F.lag("close").over(series())
    change = F.coalesce((F.col("close") - before) / F.nullif(before, F.lit(0.0)) * 100, F.lit(0.0))
    return out.withColumns({"change_pct": change, "is_limit_up": F.lit(False), "is_limit_down": F.lit(False)})


def roll_up(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of a coarser unit (hour, day) from finer ones: first open, extremes, last close, sums. Bars of a part of the
    data combine in the same way, so hours and days come from one table of half-hours. Days are dates."""
    at = F.date_trunc(unit, "date")
    return _resample(bars.where(F.col("close").isNotNull()), at.cast("date") if unit == "day" else at)


def monthly(bars: DataFrame) -> DataFrame:
    """Months labelled by their first day."""
    return _resample(bars, F.trunc("date", "MM"))


def drop_unfinished(bars: DataFrame, now: datetime) -> DataFrame:
    """Without today's bar (and later ones) as long as it is before 15:10."""
    return bars.where(F.col("date") < F.lit(now.date())) if (now.hour, now.minute) < (15, 10) else bars


def in_progress(bars: DataFrame, period: str, today: date) -> DataFrame:
    """One row a symbol: is its last bar's month, or ISO week, today's? Never for days."""
    last, now = F.max("date"), F.lit(today)
    same = {
        "month": F.trunc(last, "MM") == F.trunc(now, "MM"),
        "week": F.date_trunc("week", last) == F.date_trunc("week", now),
    }.get(period, F.lit(False))
    return bars.groupBy(KEY).agg(last.alias("last_date"), same.alias("in_progress"))


def adjustment_gate(tags: DataFrame, weekly_tags: DataFrame, accepted: str = "qfq") -> DataFrame:
    """One row a symbol: may it be evaluated, may weekly bars be used, and warnings why not. Tags come from series_tags()."""
    both = tags.join(weekly_tags.select(KEY, F.col("adjustment").alias("weekly_adjustment")), KEY, "left")
    ok = F.col("adjustment") == accepted
    same = F.coalesce(F.col("adjustment") == F.col("weekly_adjustment"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(~ok, "adjustment"), F.when(F.col("source") == "unknown", "mixed_source"), F.when(~same, "weekly_dropped")))
    return both.select(KEY, "source", "adjustment", ok.alias("eligible"), same.alias("weekly_used"), warnings.alias("warnings"))


def tail(df: DataFrame, rows: int, digits: dict[str, int]) -> DataFrame:
    """The last rows of each symbol with some columns rounded; nulls stay null."""
    out = df.withColumn("_n", from_end()).where(F.col("_n") <= rows).drop("_n")
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})
