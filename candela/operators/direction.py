"""Multi-timeframe direction: a score for each bar, labels, the monthly trend and the operating licence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.windows import KEY, clip, position, rounded, series
from candela.operators.indicators import atr, recursions, sma
from candela.operators.normalise import monthly
from candela.sources.bars import latest

LEAST_BARS, LEAST_WEEKS, LEAST_MONTHS = 15, 30, 8


def slope_atr(frame: DataFrame) -> DataFrame:
    """Mean change over four bars in units of the ATR; 0 before five bars."""
    change = (F.col("close") - F.lag("close", 4).over(series())) / 4.0
    return frame.withColumn("slope", rounded(F.coalesce(change, F.lit(0.0)) / (F.col("atr") + 1e-9), 2))


def direction_score(frame: DataFrame) -> DataFrame:
    """Score in -0.95..0.95 from the close against its means, the histogram and its turn, and J. Unfilled means count as the close."""
    c, j, hist = F.col("close"), F.col("kdj_j"), F.col("hist")
    before = F.coalesce(F.lag("hist").over(series()), hist)
    m20, m60 = F.coalesce("ma_20", "close"), F.coalesce("ma_60", "close")
    half = 0.5 * F.greatest(F.col("atr"), c * 0.005)
    turn = F.when((hist > 0) & (hist >= before), 0.35).when(hist > 0, 0.15).when((hist < 0) & (hist <= before), -0.35).when(hist < 0, -0.15).otherwise(0.0)
    extreme = F.when(j < 30, 0.1).when(j > 90, -0.15).otherwise(0.0)
    score = 0.3 * F.tanh((c - m20) / half) + 0.2 * F.tanh((m20 - m60) / half) + turn + extreme
    return frame.withColumn("score", rounded(clip(score, -0.95, 0.95), 2))


def rebound_pullback(frame: DataFrame) -> DataFrame:
    j = F.col("kdj_j")
    rebound = clip((40.0 - j) * 0.4, 0.0, 30.0)
    pullback = clip((j - 40.0) * 0.35 + 5 * F.greatest(F.col("slope"), F.lit(0.0)), 5.0, 28.0)
    return frame.withColumns({"rebound": rounded(rebound, 1), "pullback": rounded(pullback, 1)})


def status_tag(score: Column) -> Column:
    return F.when(score >= 0.3, "rising").when(score >= 0.1, "firm").when(score <= -0.3, "pressed").otherwise("range")


def macd_phase(hist: Column, dif: Column) -> Column:
    return F.when((hist > 0) & (dif >= 0), "above_growing").when(hist > 0, "below_mending").when(dif < 0, "below_widening").otherwise("above_fading")


def direction_label(score: Column) -> Column:
    return F.when(score >= 0.2, "bull").when(score >= 0.1, "weak_bull").when(score <= -0.2, "bear").when(score <= -0.1, "weak_bear").otherwise("neutral")


def directions(bars: DataFrame) -> DataFrame:
    """Every direction column of each bar of a period; a symbol under 15 bars has status insufficient."""
    frame = rebound_pullback(direction_score(slope_atr(atr(sma(recursions(bars), (20, 60))))))
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    status = F.when(n < LEAST_BARS, "insufficient").otherwise(status_tag(F.col("score")))
    return frame.withColumns({"status": status, "phase": macd_phase(F.col("hist"), F.col("dif")), "label": direction_label(F.col("score"))})


def monthly_trend(weekly: DataFrame) -> DataFrame:
    """One row a symbol: score and label of its months, or score 0 and label insufficient for short series."""
    months = monthly(weekly)
    w = series()
    last = lambda n: F.when(F.count("close").over(w.rowsBetween(-(n - 1), 0)) >= n, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
    rows = months.withColumns({"ma6": last(6), "ma12": last(12), "chg3": (F.col("close") / F.lag("close", 3).over(w) - 1) * 100, "months": position() + 1})
    rows = latest(rows.select(KEY, "date", "close", "ma6", "ma12", "chg3", "months"))
    weeks = weekly.groupBy(KEY).agg(F.count(F.lit(1)).alias("weeks"))
    score = F.when(F.col("close") > F.col("ma6"), 0.4).otherwise(-0.4) + F.when(F.col("ma12").isNull(), 0.0).when(F.col("ma6") > F.col("ma12"), 0.3).otherwise(-0.3) + clip(F.col("chg3") / 20, -0.3, 0.3)
    enough = (F.col("weeks") >= LEAST_WEEKS) & (F.col("months") >= LEAST_MONTHS)
    out = rows.join(weeks, KEY).withColumn("score", F.when(enough, rounded(clip(score, -1.0, 1.0), 2)).otherwise(0.0))
    return out.select(KEY, "months", "score", F.when(enough, direction_label(F.col("score"))).otherwise("insufficient").alias("label"))


def op_license(scores: DataFrame) -> DataFrame:
    """licence and position range from the columns weekly, daily and intraday (scores): the first rule that holds."""
    w, d, h = F.col("weekly"), F.col("daily"), F.col("intraday")
    conflict = (w * d < 0) & (F.least(F.abs(w), F.abs(d)) >= 0.1)
    rules = [((w >= 0.2) & (d >= 0.2), "long", "70-85"), ((w < 0) & (d < 0), "defend", "10-30"), (conflict, "conflict", "30-50"), ((w >= 0.1) & (d >= 0) & (h > 0), "range", "50-65")]
    licence, share = F.lit("wait"), F.lit("30-50")
    for condition, name, part in reversed(rules):
        licence, share = F.when(condition, name).otherwise(licence), F.when(condition, part).otherwise(share)
    return scores.withColumns({"licence": licence, "position_pct": share})


def key_levels(prices: DataFrame, bands: DataFrame) -> DataFrame:
    """s1, s2, r1 and r2 of each symbol, made from the close (or from the first level) where a band is missing."""
    wide = bands.where(F.col("nth") <= 2).groupBy(KEY).agg(*(F.max(F.when(F.col("label") == x.upper(), F.col("centre"))).alias(f"_{x}") for x in ("s1", "s2", "r1", "r2")))
    out = prices.select(KEY, "close").join(wide, KEY, "left")
    out = out.withColumns({"s1": F.coalesce("_s1", rounded(F.col("close") * 0.985, 2)), "r1": F.coalesce("_r1", rounded(F.col("close") * 1.025, 2))})
    out = out.withColumns({"s2": F.coalesce("_s2", rounded(F.col("s1") * 0.98, 2)), "r2": F.coalesce("_r2", rounded(F.col("r1") * 1.02, 2))})
    return out.select(KEY, "close", "s1", "s2", "r1", "r2")


def timeframe_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row a symbol: a map from timeframe to (label, score, status) of its last bar; parts: frames of directions()."""
    rows = None
    for name, frame in parts.items():
        one = latest(frame.select(KEY, "date", "label", "score", "status")).select(KEY, F.struct(F.lit(name).alias("key"), F.struct("label", "score", "status").alias("value")).alias("e"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("timeframes"))
