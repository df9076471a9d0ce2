"""Momentum resonance: rebound and pullback pressure scores, the turning trigger, permissions and decisions.

These operators use their own indicator dialect: RSI 14 is 50 before 15 bars and counts no loss as a ratio of 100; KDJ
takes a flat range as 50; the ATR averages a partial window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import affine_scan, decay_step, ema_step
from candela.functions.ranks import moving_ranks
from candela.functions.windows import KEY, clip, last_rows, moving_means, position, rounded, score_sum, series
from candela.operators.indicators import run_length, true_range

LEAST_BARS, WINDOW = 30, 250


def indicators(bars: DataFrame) -> DataFrame:
    """rsi14, KDJ, MACD and ATR of the dialect."""
    n = position()
    delta = F.col("close") - F.lag("close").over(series())
    out = bars.withColumns({"_i": n, "_delta": delta, "_tr": true_range()})
    w = last_rows(14)
    gain, loss = F.sum(F.greatest("_delta", F.lit(0.0))).over(w) / 14, F.sum(F.greatest(-F.col("_delta"), F.lit(0.0))).over(w) / 14
    ratio = F.when(loss == 0, 100.0).otherwise(gain / F.nullif(loss, F.lit(0.0)))
    low, high = F.min("low").over(last_rows(9)), F.max("high").over(last_rows(9))
    rsv = F.when((F.col("_i") < 8) | (high == low), 50.0).otherwise((F.col("close") - low) / F.nullif(high - low, F.lit(0.0)) * 100)
    out = out.withColumns({"rsi14": F.when(F.col("_i") < 14, 50.0).otherwise(100 - 100 / (1 + ratio)), "atr14": F.avg("_tr").over(w), "_rsv": rsv})
    close, third = F.col("close"), 1.0 / 3
    out = affine_scan(out, {"fast": ema_step(close, 12), "slow": ema_step(close, 26), "k": decay_step(F.col("_rsv"), third, 50.0)})
    out = out.withColumn("dif", F.col("fast") - F.col("slow"))
    out = affine_scan(out, {"dea": ema_step(F.col("dif"), 9), "d": decay_step(F.col("k"), third, 50.0)})
    return out.withColumns({"hist": 2 * (F.col("dif") - F.col("dea")), "j": 3 * F.col("k") - 2 * F.col("d")}).drop("_delta", "_tr", "_rsv", "fast", "slow")


def resonance_features(bars: DataFrame) -> DataFrame:
    """The factors of the scores for each bar, rounded to ten digits so that steps don't hang on a last bit."""
    w = series()
    out = indicators(bars)
    out = out.withColumn("_before", F.lag("close").over(w))
    out = run_length(run_length(out, F.col("close") < F.col("_before"), "down_run"), F.col("close") > F.col("_before"), "up_run")
    out = moving_means(out, F.col("close"), {"_m20": 20})
    m20 = F.coalesce("_m20", "close")
    factors = {
        "rsi14": F.col("rsi14"), "j": F.col("j"), "deviation": (F.col("close") - m20) / F.nullif(m20, F.lit(0.0)) * 100, "hist": F.col("hist"), "prev_hist": F.coalesce(F.lag("hist").over(w), F.lit(0.0)),
        "vol_ratio": F.avg("volume").over(last_rows(5)) / F.avg("volume").over(last_rows(20)), "chg_5": F.coalesce((F.col("close") / F.lag("close", 5).over(w) - 1) * 100, F.lit(0.0)),
    }
    return out.withColumns({k: F.round(v, 10) for k, v in factors.items()}).drop("_before", "_m20")


def rd_cd_scores(features: DataFrame) -> DataFrame:
    """rd (need for a rebound) and cd (pressure to pull back), each a sum of seven stepped factors."""
    r, j, dev, chg, vol = (F.col(c) for c in ("rsi14", "j", "deviation", "chg_5", "vol_ratio"))
    hist, before, down, up = (F.col(c) for c in ("hist", "prev_hist", "down_run", "up_run"))

    def steps(*cases: tuple[Column, int]) -> Column:
        out = F.lit(0)
        for condition, points in reversed(cases):
            out = F.when(condition, points).otherwise(out)
        return out

    rd = (
        steps((r < 20, 25), (r < 30, 18), (r < 40, 8)) + steps((j < 0, 20), (j < 10, 14), (j < 20, 7)) + steps((dev < -5, 22), (dev < -3, 14), (dev < -1.5, 6))
        + steps(((hist < 0) & (before < 0) & (hist > before), 10)) + steps((down >= 5, 15), (down >= 3, 8)) + steps(((vol < 0.6) & (dev < -2), 10)) + steps((chg < -8, 12), (chg < -5, 6))
    )
    cd = (
        steps((r > 80, 25), (r > 70, 18), (r > 60, 8)) + steps((j > 100, 20), (j > 90, 14), (j > 80, 7)) + steps((dev > 5, 22), (dev > 3, 14), (dev > 1.5, 6))
        + steps(((hist > 0) & (before > 0) & (hist < before), 10)) + steps((up >= 5, 15), (up >= 3, 8)) + steps(((vol > 1.8) & (dev > 2), 10)) + steps((chg > 8, 12), (chg > 5, 6))
    )
    return features.withColumns({"rd": rd, "cd": cd})


def turning_trigger(features: DataFrame) -> DataFrame:
    """g in -1..1: crossings of MACD and KDJ (or the MACD gap's change in ATRs) and the two-bar return."""
    w = series()
    gap = F.col("dif") - F.col("dea")
    before, kd, kd_before = F.lag(gap).over(w), F.col("k") - F.col("d"), F.lag(F.col("k") - F.col("d")).over(w)
    before, kd_before = F.coalesce(before, F.lit(0.0)), F.coalesce(kd_before, F.lit(0.0))
    macd = F.when((before <= 0) & (gap > 0), 0.3).when((before >= 0) & (gap < 0), -0.3).otherwise(clip(4 * (gap - before) / F.nullif(F.col("atr14"), F.lit(0.0)), -0.3, 0.3))
    kdj = F.when((kd_before <= 0) & (kd > 0), 0.2).when((kd_before >= 0) & (kd < 0), -0.2).otherwise(0.0)
    price = clip(F.coalesce((F.col("close") / F.lag("close", 2).over(w) - 1) * 10, F.lit(0.0)), -0.3, 0.3)
    return features.withColumn("g", rounded(clip(F.coalesce(macd, F.lit(0.0)) + kdj + price, -1.0, 1.0), 2))


def trailing_percentile(scored: DataFrame) -> DataFrame:
    """rd_pct and cd_pct: share of the last 250 scores, from the 31st bar on, that are not above the bar's own."""
    out = scored.withColumns({f"_{c}": F.when(F.col("_i") >= LEAST_BARS, F.col(c)) for c in ("rd", "cd")})
    out = moving_ranks(out, ["_rd", "_cd"], WINDOW)
    share = lambda c: rounded(100 * F.col(f"_{c}_upto") / F.nullif(F.col(f"_{c}_n"), F.lit(0)), 1)
    out = out.withColumns({f"{c}_pct": F.coalesce(share(c), F.lit(0.0)) for c in ("rd", "cd")})
    return out.drop(*(f"_{c}{x}" for c in ("rd", "cd") for x in ("", "_n", "_below", "_upto")))


def resonance_labels(scored: DataFrame) -> DataFrame:
    """Labels of rd and cd at 60, 40, 25 and 10, and of g at 0.15 and 0.05."""
    def chip(x: Column) -> Column:
        return F.when(x >= 60, "extreme").when(x >= 40, "marked").when(x >= 25, "moderate").when(x >= 10, "weak").otherwise("neutral")

    g = F.col("g")
    state = F.when(g >= 0.15, "turning_up").when(g <= -0.15, "turning_down").when(g > 0.05, "leaning_up").when(g < -0.05, "leaning_down").otherwise("neutral")
    return scored.withColumns({"rd_label": chip(F.col("rd")), "cd_label": chip(F.col("cd")), "g_label": state})


def stage_trend(bars: DataFrame) -> DataFrame:
    """trend_score and trend_label of each bar from its means and five-bar change."""
    c = F.col("close")
    bars = moving_means(bars, c, {"_m5": 5, "_m20": 20})
    m5, m20 = F.coalesce("_m5", "close"), F.coalesce("_m20", "close")
    first = F.first("close").over(last_rows(6))
    change = (c - first) / F.nullif(first, F.lit(0.0)) * 100
    score = score_sum((c > m5, 0.2), (~(c > m5), -0.2), (c > m20, 0.3), (~(c > m20), -0.3), (m5 > m20, 0.2), (~(m5 > m20), -0.2), (change > 3, 0.2), (change < -3, -0.2))
    out = bars.withColumn("trend_score", F.round(score, 4)).drop("_m5", "_m20")
    s = F.col("trend_score")
    return out.withColumn("trend_label", F.when(s > 0.5, "bull").when(s > 0.2, "weak_bull").when(s < -0.5, "bear").when(s < -0.2, "weak_bear").otherwise("neutral"))


def permission_cap(state: DataFrame) -> DataFrame:
    """cap by the month, permission by week and day, rhythm by 60 and 30 minutes; state: trend_score and labels and scores of the timeframes."""
    weekly, month, day, h60, h30 = (F.col(c) for c in ("weekly_label", "monthly_label", "trend_score", "score_60m", "score_30m"))
    cap = F.when(month == "bear", "light").when(month == "weak_bear", "half").otherwise("normal")
    bear = weekly.isin("bear", "weak_bear")
    permission = F.when(bear | (day < -0.3), "pause").when((day > 0.6) & (weekly == "bull"), F.when(cap == "normal", "full").otherwise("half")).when(day > 0.3, "light").otherwise("watch")
    capped = F.when((cap == "light") & permission.isin("full", "half", "light"), "light").otherwise(permission)
    rhythm = F.when(h60.isNull() | h30.isNull(), "unknown").when((h60 > 0.1) & (h30 > 0.1), "both_up").when((h60 < -0.1) & (h30 < -0.1), "both_down").when((h60 > 0.1) & (h30 <= 0.1), "pullback").when((h60 <= -0.1) & (h30 > 0.1), "rebound").otherwise("range")
    return state.withColumns({"cap": cap, "permission": capped, "rhythm": rhythm})


def decision(state: DataFrame) -> DataFrame:
    """action from the scores, overridden where the permission pauses."""
    rd, cd, g = F.col("rd"), F.col("cd"), F.col("g")
    action = F.when((rd >= 40) & (g >= 0.15), "rebound").when((cd >= 40) & (g <= -0.15), "pullback").when(rd >= 25, "oversold_watch").when(cd >= 25, "overbought_watch").otherwise("wait")
    paused = F.when(F.col("weekly_label").isin("bear", "weak_bear"), "weekly_forbids").otherwise("unclear")
    return state.withColumn("action", F.when(F.col("permission") == "pause", paused).otherwise(action))


def maturity(state: DataFrame) -> DataFrame:
    """How ripe a rebound, a pullback and a trigger are; state: rd, cd, g and the daily score."""
    g = F.col("g")
    ripe = lambda x, up: F.least(F.lit(100.0), F.floor(1.2 * F.col(x) + 50 * F.greatest(up, F.lit(0.0)) + 0.5).cast("double"))
    return state.withColumns({"rebound_ripe": ripe("rd", g), "pullback_ripe": ripe("cd", -g), "trigger": F.floor(30 * F.col("score_day") + 20 * g + 0.5).cast("double")})


def confirmation_ladder(state: DataFrame) -> DataFrame:
    """Number of timeframes that speak: 60 minutes, day and week."""
    flags = (F.abs("score_60m") >= 0.1, F.abs("score_day") >= 0.1, F.abs("score_week") > 0.3)
    return state.withColumn("confirmed", sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0)))


def cold_environment(bars: DataFrame) -> DataFrame:
    """Falls of over 1.5 % among the last five bars, as cold, cool or normal; bars need change_pct."""
    n = F.sum(F.when(F.col("change_pct") < -1.5, 1).otherwise(0)).over(last_rows(5))
    return bars.withColumns({"cold_days": n, "environment": F.when(n >= 3, "cold").when(n >= 1, "cool").otherwise("normal")})


def direction_confirmation(state: DataFrame) -> DataFrame:
    g, day = F.col("g"), F.col("score_day")
    return state.withColumn("confirmation", F.when((g >= 0.15) & (day > 0.2), "up").when((g <= -0.15) & (day < -0.2), "down").otherwise("none"))


def resonance(bars: DataFrame) -> DataFrame:
    """Features, scores, trigger, percentiles and labels of each bar of series with 30 bars or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    rows = bars.withColumn("_n", n).where(F.col("_n") >= LEAST_BARS).drop("_n")
    return resonance_labels(trailing_percentile(turning_trigger(rd_cd_scores(resonance_features(rows))))).drop("_i")
