"""Scores, signal, trade plan and screens of one state row a symbol.

A state row has the last indicator values (close, ma_20, ma_60, ma_120, atr, kdj_j, hist, vol_ratio, boll_lower, n bars),
the last weekly ones (week_close, week_ma_20, week_ma_60), profile values (poc, profit_ratio, conc_90), divergence flags,
volume features and the bands (supports and resistances: arrays of centre prices outwards from the close).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.windows import KEY, clip, position, rounded, score_sum, series
from candela.sources.bars import latest

COST, STOP_ATR, MOST_RISK, FAR = 0.5, 3.0, 12.0, 3.0
#: Names of the screens.
STRATEGIES = ("SUPPORT_PULLBACK", "BREAKOUT_PRESSURE", "MAIN_WAVE_TREND", "OVERSOLD_DIVERGENCE")
WEIGHTS = ("w_trend", "w_chips", "w_momentum", "w_position")


def state_rows(daily: DataFrame, weekly: DataFrame, summary: DataFrame, divergence: DataFrame, features: DataFrame, bands: DataFrame) -> DataFrame:
    """One row a symbol from the parts above; parts that a symbol lacks are null, its bands empty."""
    counted = latest(daily)
    if "n" not in daily.columns:
        counted = counted.join(daily.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY)
    marks = latest(features.select(KEY, "date", "is_breakout", "is_shrink", "vp_state")).drop("date")
    day = counted.join(divergence.drop("date"), KEY, "left").join(marks, KEY, "left")
    return join_state(day, latest(weekly), summary, bands)


def join_state(day: DataFrame, week: DataFrame, summary: DataFrame, bands: DataFrame) -> DataFrame:
    """state_rows() from tables with one row a symbol; day: the newest bar with n, the divergences and the volume marks."""
    week = week.select(KEY, *(F.col(c).alias(f"week_{c}") for c in ("close", "ma_20", "ma_60")))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("nth", "centre")))), lambda x: x["centre"])
    lists = bands.groupBy(KEY).agg(side("support").alias("supports"), side("resistance").alias("resistances"))
    out = day.join(week, KEY, "left").join(summary, KEY, "left").join(lists, KEY, "left")
    none = F.array().cast("array<double>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("supports", "resistances")})


def adaptive_weights(state: DataFrame) -> DataFrame:
    """Weights of trend, chips, momentum and position by market regime; each row's sum to 1."""
    c, m20, m60 = F.col("close"), F.col("ma_20"), F.col("ma_60")
    wc, w20, w60 = F.col("week_close"), F.col("week_ma_20"), F.col("week_ma_60")
    cases = [
        (F.col("n") < 30, (0.25, 0.25, 0.25, 0.25)), ((wc > w20) & (w20 > w60) & (c > m20) & (m20 > m60), (0.35, 0.20, 0.20, 0.25)),
        ((wc < w20) & (w20 < w60) & (c < m20) & (m20 < m60), (0.35, 0.20, 0.25, 0.20)), ((F.col("kdj_j") < 20) | (F.col("kdj_j") > 90), (0.20, 0.25, 0.35, 0.20)),
        (F.col("atr") / (c + 1e-9) < 0.015, (0.20, 0.30, 0.20, 0.30)),
    ]
    out = state
    for k, name in enumerate(WEIGHTS):
        value = F.lit(0.25)
        for condition, weights in reversed(cases):
            value = F.when(condition, weights[k]).otherwise(value)
        out = out.withColumn(name, value)
    return out


def normalise_weights(state: DataFrame) -> DataFrame:
    """The position weight is off; the others are scaled to sum to 1."""
    total = F.col("w_trend") + F.col("w_chips") + F.col("w_momentum")
    out = state.withColumn("_total", total)
    return out.withColumns({c: F.col(c) / F.col("_total") for c in WEIGHTS[:3]} | {"w_position": F.lit(0.0)}).drop("_total")


def trend_score(state: DataFrame) -> DataFrame:
    c, m20, m60, m120 = (F.col(x) for x in ("close", "ma_20", "ma_60", "ma_120"))
    wc, w20, w60 = F.col("week_close"), F.col("week_ma_20"), F.col("week_ma_60")
    bull, bear = (wc > w20) & (w20 >= w60), (wc < w20) & (w20 < w60)
    points = 50 + score_sum(((c > m20) & (m20 > m60), 20), ((c < m20) & (m20 < m60), -20), ((c > m20) & (m20 > m60) & (m60 > m120), 10), (bull, 20), (bear, -20))
    return state.withColumns({"trend_score": clip(points, 5.0, 95.0), "weekly_trend": F.when(bull, "bull").when(bear, "bear").otherwise("range")})


def chip_score(state: DataFrame) -> DataFrame:
    """Missing profile values count as neutral."""
    share, wide, c, poc = F.coalesce("profit_ratio", F.lit(50.0)), F.coalesce("conc_90", F.lit(20.0)), F.col("close"), F.coalesce("poc", F.col("close"))
    points = 50 + score_sum((share >= 80, 25), ((share >= 60) & (share < 80), 15), (share <= 15, -20), (wide <= 10, 15), (wide >= 25, -10), ((c >= poc * 0.98) & (c <= poc * 1.03), 10))
    return state.withColumn("chip_score", clip(points, 5.0, 95.0))


def momentum_score(state: DataFrame) -> DataFrame:
    """State needs trend_score."""
    hist, gap, j, vp = F.col("hist"), F.col("dif") - F.col("dea"), F.col("kdj_j"), F.col("vp_state")
    points = 50 + score_sum(
        ((hist > 0) & (gap > 0), 15), ((hist < 0) & (gap < 0), -15), (F.col("bullish_divergence"), 25), (F.col("bearish_divergence"), -25),
        ((j < 20) & (F.col("trend_score") >= 45), 15), ((j < 20) & (F.col("trend_score") < 45), 5), (j > 95, -15), (F.col("is_breakout"), 12), (F.col("is_shrink"), 8),
        (vp == "bearish_vp", -10), (vp == "bullish_vp", 8), (vp == "panic", -12),
    )
    return state.withColumn("momentum_score", clip(points, 5.0, 95.0))


def distances(state: DataFrame) -> DataFrame:
    """s1, r1 and their distances from the close in percent (999 if there is none)."""
    c = F.col("close")
    out = state.withColumns({"s1": F.try_element_at("supports", F.lit(1)), "r1": F.try_element_at("resistances", F.lit(1))})
    return out.withColumns({"s_dist": F.coalesce((c - F.col("s1")) / c * 100, F.lit(999.0)), "r_dist": F.coalesce((F.col("r1") - c) / c * 100, F.lit(999.0))})


def position_score(state: DataFrame) -> DataFrame:
    """For display only; state needs distances()."""
    near, far = F.col("r1").isNotNull() & F.col("r_dist").between(0, 1.2), F.col("r1").isNotNull() & (F.col("r_dist") > 6.0)
    points = 50 + score_sum((F.col("s1").isNotNull() & (F.col("s_dist") < 0), -20), (near, -20), (far, 15))
    return state.withColumn("position_score", clip(points, 5.0, 95.0))


def composite_score(state: DataFrame) -> DataFrame:
    """bullish_score and its complement, and the clipped older field."""
    total = F.col("trend_score") * F.col("w_trend") + F.col("chip_score") * F.col("w_chips") + F.col("momentum_score") * F.col("w_momentum") + F.col("position_score") * F.col("w_position")
    out = state.withColumn("bullish_score", rounded(clip(total, 0.0, 100.0), 1))
    return out.withColumns({"bearish_score": rounded(100.0 - F.col("bullish_score"), 1), "bullish_clipped": clip(F.col("bullish_score"), 15.0, 92.0)})


def signal_type(state: DataFrame) -> DataFrame:
    """The first rule that holds."""
    bull, bear, s, r = F.col("bullish_score"), F.col("bearish_score"), F.col("s_dist"), F.col("r_dist")
    signal = (
        F.when((bull >= 75) & ((s <= 3.0) | F.coalesce("bullish_divergence", F.lit(False))), "BUY_SUPPORT_PULLBACK")
        .when((bull >= 70) & (r <= 1.5) & (F.col("vol_ratio") >= 1.5), "BUY_BREAKOUT")
        .when((bear >= 65) & (r <= 1.5), "SELL_RESISTANCE_REJECT")
        .when((bear >= 65) & (s < 0), "SELL_BREAKDOWN")
        .otherwise("HOLD_WATCH")
    )
    return state.withColumn("signal", signal)


def trade_plan(state: DataFrame) -> DataFrame:
    """Entry range, stop, two targets, expected gain and loss net of costs, their ratio and its label. Prices have two digits.

    rr_quality: no_entry for a ratio of 0 (the stop isn't below the close, or nothing is to be gained), excellent from 3, good from 2.
    """
    c, s1, atr = F.col("close"), F.col("s1"), F.coalesce("atr", F.col("close") * 0.02)
    out = state.withColumns({
        "entry_low": rounded(F.coalesce(s1 * 0.992, c * 0.985), 2),
        "entry_high": rounded(F.when(s1.isNotNull(), F.greatest(c * 1.003, s1 * 1.015)).otherwise(c * 1.005), 2),
        "_far": F.filter("resistances", lambda r: (r - c) / c * 100 >= FAR),
    })
    stop = F.when(s1.isNotNull(), F.least(s1 * 0.975, F.col("entry_low") - STOP_ATR * atr)).otherwise(c - STOP_ATR * atr)
    out = out.withColumn("stop_loss", rounded(F.greatest(stop, c * (1 - MOST_RISK / 100)), 2))
    out = out.withColumn("tp_1", rounded(F.coalesce(F.try_element_at("_far", F.lit(1)), F.col("r1"), c * 1.08), 2))
    after = F.filter("_far", lambda r: r > F.col("tp_1") * 1.001)
    out = out.withColumn("tp_2", rounded(F.coalesce(F.try_element_at(after, F.lit(1)), F.col("tp_1") * 1.06), 2))
    out = out.withColumns({"gain_pct": rounded((F.col("tp_1") - c) / c * 100 - 2 * COST, 2), "loss_pct": rounded((c - F.col("stop_loss")) / c * 100 + 2 * COST, 2)})
    ratio = F.when((F.col("loss_pct") > 0) & (F.col("gain_pct") > 0), rounded(F.col("gain_pct") / F.nullif(F.col("loss_pct"), F.lit(0.0)), 2)).otherwise(0.0)
    out = out.withColumn("rr_ratio", ratio)
    rr = F.col("rr_ratio")
    quality = F.when(rr <= 0, "no_entry").when(rr >= 3.0, "excellent").when(rr >= 2.0, "good").otherwise("ordinary")
    return out.withColumns({"rr_quality": quality, "holding": F.when(F.col("bullish_score") >= 70, "short").otherwise("medium")}).drop("_far")


def screens(state: DataFrame) -> DataFrame:
    """strategies: names of the screens that a row passes."""
    j, vr = rounded(F.col("kdj_j"), 1), rounded(F.col("vol_ratio"), 2)
    s, r = F.col("s_dist"), F.col("r_dist")
    tests = {
        "SUPPORT_PULLBACK": s.between(0, 2.5) & ((j < 30) | (F.col("signal") == "BUY_SUPPORT_PULLBACK")) & (F.col("rr_ratio") >= 2.2),
        "BREAKOUT_PRESSURE": (vr >= 1.6) & r.between(-1.5, 2.5) & (F.col("profit_ratio") >= 70),
        "MAIN_WAVE_TREND": (F.col("weekly_trend") == "bull") & (F.col("conc_90") <= 10) & (F.col("close") > F.col("poc") * 1.02),
        "OVERSOLD_DIVERGENCE": ((F.col("close") <= F.col("boll_lower") * 1.01) | F.col("bullish_divergence")) & (j < 15) & (vr <= 1.2),
    }
    return state.withColumn("strategies", F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items()))))


def similar_patterns(frame: DataFrame, state: DataFrame, gap: int = 10, first: int = 30, longest: int = 20, least: int = 5) -> DataFrame:
    """One row a symbol: how past bars that meet its active conditions went on, 5, 10 and 20 bars after.

    Active are: near support (close to ma_20), oversold (J up to 45), uptrend (ma_60 not above ma_20). Samples keep `gap`
    bars between them, earliest first; a low at three ATRs below ends a path at the stop; costs are taken off. Rates are
    null under `least` samples. In sample: a description, not a trading result.
    """
    w = series()
    active = state.select(
        KEY, (F.col("s_dist") <= 3.0).alias("_near"), ((F.col("kdj_j") < 35) | F.coalesce("bullish_divergence", F.lit(False))).alias("_low"), (F.col("trend_score") >= 55).alias("_up"),
    )
    c = F.col("close")
    stop = c - STOP_ATR * F.when(F.col("atr") > 0, F.col("atr")).otherwise(c * 0.02)
    rows = frame.withColumns({"_i": position(), "_n": F.count(F.lit(1)).over(Window.partitionBy(KEY)), "_stop": stop})
    for h in (5, 10, 20):
        touched = F.min("low").over(w.rowsBetween(1, h)) <= F.col("_stop")
        rows = rows.withColumn(f"_g{h}", (F.when(touched, F.col("_stop")).otherwise(F.lead("close", h).over(w)) - c) / c * 100 - 2 * COST)
    rows = rows.join(active, KEY).where((F.col("_near") | F.col("_low") | F.col("_up")) & F.col("_i").between(first, F.col("_n") - longest - 1))
    near = F.coalesce((c >= 0.975 * F.col("ma_20")) & (c <= 1.03 * F.col("ma_20")), F.lit(False))
    rows = rows.where((~F.col("_near") | near) & (~F.col("_low") | (F.col("kdj_j") <= 45)) & (~F.col("_up") | ~F.coalesce(F.col("ma_60") > F.col("ma_20"), F.lit(False))))
    found = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), *(F.col(f"_g{h}").alias(f"g{h}") for h in (5, 10, 20))))).alias("m"))
    none = F.slice("m", 1, 0)
    kept = F.aggregate("m", none, lambda a, x: F.when((F.size(a) == 0) | (x["i"] - F.try_element_at(a, F.lit(-1))["i"] >= gap), F.concat(a, F.array(x))).otherwise(a))
    samples = found.select(KEY, F.explode(kept).alias("s")).select(KEY, "s.*")
    n = F.count(F.lit(1))
    rate = lambda h: F.when(n >= least, rounded(100 * F.avg((F.col(f"g{h}") > 0).cast("double")), 1)).alias(f"win_{h}")
    stats = samples.groupBy(KEY).agg(n.alias("samples"), rate(5), rate(10), rate(20), F.when(n >= least, rounded(F.avg("g10"), 1)).alias("mean_10"))
    out = state.select(KEY).join(stats, KEY, "left").withColumn("samples", F.coalesce("samples", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("samples") >= least, "sufficient").otherwise("insufficient"))


def universe_filter(quotes: DataFrame, count: int, least_price: float = 2.0, least_amount: float = 1e7, barred: tuple[str, ...] = ("ST", "*ST", "退")) -> DataFrame:
    """Quotes with a sound name, price and amount, the largest by amount."""
    named = ~F.lit(False)
    for b in barred:
        named = named & ~F.col("name").startswith(b)
    return quotes.where(named & (F.col("close") > least_price) & (F.col("amount") > least_amount)).orderBy(F.desc("amount"), KEY).limit(count)


def scan_rank(scored: DataFrame, strategy: str | None = None) -> DataFrame:
    """Rows that pass a screen (or the named one), best score first, then best ratio."""
    keep = F.size("strategies") > 0 if strategy is None else F.array_contains("strategies", strategy)
    return scored.where(keep).orderBy(F.desc("bullish_score"), F.desc("rr_ratio"), KEY)


def instrument_search(instruments: DataFrame, text: str, most: int = 60) -> DataFrame:
    """Instruments whose code, name or industry holds the text, the case of letters aside."""
    t = text.strip().upper()
    hit = F.lit(False)
    for c in (F.col(KEY).cast("string"), F.col("name"), F.col("industry")):
        hit = hit | F.coalesce(F.upper(c).contains(t), F.lit(False))
    return instruments.where(hit).orderBy(KEY).limit(most)


def score_all(state: DataFrame) -> DataFrame:
    """Every score, the signal, the plan and the screens."""
    for step in (adaptive_weights, normalise_weights, trend_score, chip_score, momentum_score, distances, position_score, composite_score, signal_type, trade_plan, screens):
        state = step(state)
    return state
