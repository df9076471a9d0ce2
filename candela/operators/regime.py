"""Regime features, the cold score and the threshold probability with its out-of-sample calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import Step, affine_scan
from candela.functions.stats import SQRT_10, normal_tail, wilson
from candela.functions.ranks import moving_ranks
from candela.functions.windows import KEY, full, last_rows, moving_means, rounded, series
from candela.operators.indicators import run_length

LEAST_BARS, HORIZON, THRESHOLD = 260, 10, 2.5
RANK_WINDOW, RANK_LEAST = 250, 120
#: Weights of the cold score's parts and of the three variance estimates, and the decay of the second.
ICE_WEIGHTS = {"ice_ret20": 0.18, "ice_dev": 0.17, "ice_vol": 0.18, "ice_margin": 0.17, "ice_ret60": 0.15, "ice_consec": 0.15}
VARIANCE_WEIGHTS, DECAY = (0.4, 0.3, 0.3), 0.94
SCORE_EDGES = (0, 20, 40, 60, 80, 101)
RELIABILITY_EDGES = (0.0, 0.15, 0.25, 0.35, 0.45, 1.0)
PRIOR, OVERLAP = 20.0, 11
#: Iterations of the bootstrap in a row.
DRAWN = 100


def regime_features(bars: DataFrame) -> DataFrame:
    """ma200, returns over 20 and 60 bars, distances from the 20-bar mean and the 60-bar low, volume against its mean."""
    c, w = F.col("close"), series()
    out = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY))).where(F.col("_n") >= LEAST_BARS).drop("_n")
    low = full(F.min("low").over(last_rows(60)), F.col("low"), 60)
    volume = full(F.avg("volume").over(last_rows(20)), F.col("volume"), 20)
    out = moving_means(out, c, {"ma200": 200, "_ma20": 20})
    return out.withColumns({
        "ret20": (c / F.lag(c, 20).over(w) - 1) * 100, "ret60": (c / F.lag(c, 60).over(w) - 1) * 100,
        "dev_ma20": (c / F.col("_ma20") - 1) * 100, "dist_low60": (c / low - 1) * 100, "vol_ratio20": F.col("volume") / F.nullif(volume, F.lit(0.0)),
    }).drop("_ma20")


def funding_join(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """funding_5d: change of the balance over five reports in percent, by date, then one bar later (what was known then).

    funding has one row a date; its own series is one ordered by date, so it stays small beside the bars.
    """
    f = funding.select(F.lit(0).alias(KEY), "date", F.when(F.col("balance") > 0, F.col("balance")).alias("balance"))
    change = rounded((F.col("balance") / F.lag("balance", 5).over(series()) - 1) * 100, 2)
    f = f.select("date", "balance", change.alias("_5d"))
    out = bars.join(f, "date", "left")
    return out.withColumn("funding_5d", F.lag("_5d").over(series())).drop("_5d")


def ice_ranks(features: DataFrame) -> DataFrame:
    """Ranks of the six parts of the cold score: the share of a part's last RANK_WINDOW rows' values, its own included, that are
    below it; null before RANK_LEAST of them or if it is null. features need regime_features(), funding_5d and down_run."""
    raws = {
        "ice_ret20": -F.col("ret20"), "ice_dev": -F.col("dev_ma20"), "ice_ret60": -F.col("ret60"),
        "ice_vol": F.when(F.col("vol_ratio20") > 0, 1 / F.col("vol_ratio20")), "ice_margin": -F.col("funding_5d"), "ice_consec": F.col("down_run").cast("double"),
    }
    out = features.withColumns({f"_{k}": v for k, v in raws.items()})
    out = moving_ranks(out, [f"_{k}" for k in raws], RANK_WINDOW)
    share = lambda k: F.when(F.col(f"_{k}_n") >= RANK_LEAST, F.col(f"_{k}_below") / F.nullif(F.col(f"_{k}_n"), F.lit(0)))
    return out.withColumns({k: share(k) for k in raws}).drop(*(f"_{k}{x}" for k in raws for x in ("", "_n", "_below", "_upto")))


def ice_score(ranked: DataFrame) -> DataFrame:
    """Weighted mean of the parts that are there, 0 to 100 (0 without any)."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in ICE_WEIGHTS.items():
        total = total + F.coalesce(F.col(c) * w, F.lit(0.0))
        weight = weight + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    return ranked.withColumn("ice_score", F.when(weight > 0, rounded(total / F.nullif(weight, F.lit(0.0)) * 100, 1)).otherwise(0.0))


def blended_volatility(bars: DataFrame) -> DataFrame:
    """sigma_pct (a day) and sigma10_pct: high-low range, decayed squared returns and the 250-bar deviation, blended."""
    step = F.log(F.col("close") / F.lag("close").over(series()))
    base = bars.withColumns({"_ret": step, "_range": F.pow(F.log(F.col("high") / F.col("low")), 2)})
    square, earlier = F.col("_ret") * F.col("_ret"), series().rowsBetween(Window.unboundedPreceding, -1)
    first = F.count("_ret").over(earlier) == 0
    # A missing return leaves the variance as it is.
    decayed = Step(
        F.col("_ret").isNotNull() & first, F.when(F.col("_ret").isNull(), 1.0).otherwise(DECAY),
        F.when(F.col("_ret").isNull(), 0.0).when(first, square).otherwise((1 - DECAY) * square),
    )
    out = affine_scan(base, {"_ewma": decayed})
    parkinson = full(F.avg("_range").over(last_rows(20)), F.col("_range"), 20) / (4 * math.log(2))
    anchor = F.pow(full(F.stddev_samp("_ret").over(last_rows(250)), F.col("_ret"), 250), 2)
    a, b, c = VARIANCE_WEIGHTS
    out = out.withColumn("_var", a * parkinson + b * F.col("_ewma") + c * anchor)
    sigma = F.sqrt(F.when(F.col("_var") > 0, F.col("_var"))) * 100
    return out.withColumns({"sigma_pct": sigma, "sigma10_pct": sigma * SQRT_10}).drop("_ret", "_range", "_ewma", "_var")


def exceedance_probability(sigma: Column, threshold: float = THRESHOLD, drift: float = 0.0) -> Column:
    """P(return over the horizon >= threshold percent) for a normal return; null unless sigma is above 0."""
    return F.when(sigma > 0, normal_tail((threshold - drift) / F.nullif(sigma, F.lit(0.0))))


def forward_labels(bars: DataFrame, horizon: int = HORIZON, threshold: float = THRESHOLD) -> DataFrame:
    """fwd10 and trade_ret in percent and the rebound flag; null until the horizon has passed."""
    later = F.lead("close", horizon).over(series())
    out = bars.withColumns({"fwd10": (later / F.col("close") - 1) * 100, "trade_ret": (later / F.lead("open").over(series()) - 1) * 100})
    return out.withColumn("rebound", (F.col("fwd10") >= threshold).cast("int"))


def volatility_bands(df: DataFrame) -> DataFrame:
    """Bounds of the 10-bar return in percent: one deviation (68 %) and 1.645 (90 %)."""
    s = F.col("sigma10_pct")
    return df.withColumns({"low_68": -s, "high_68": s, "low_90": -1.645 * s, "high_90": 1.645 * s})


def band_coverage(df: DataFrame) -> DataFrame:
    """Realised shares inside the bands of each symbol, in percent, over rows with both a band and a label."""
    rows = df.where(F.col("sigma10_pct").isNotNull() & F.col("fwd10").isNotNull())
    inside = lambda z: 100 * F.avg((F.abs(F.col("fwd10")) <= z * F.col("sigma10_pct")).cast("double"))
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), inside(1.0).alias("coverage_68"), inside(1.645).alias("coverage_90"))


def score_bin(score: Column) -> Column:
    """0..4 for [0,20), [20,40), [40,60), [60,80), [80,100]; other scores raise an error."""
    value = F.raise_error(F.lit("score out of range")).cast("int")
    for k in range(len(SCORE_EDGES) - 1):
        value = F.when((score >= SCORE_EDGES[k]) & (score < SCORE_EDGES[k + 1]) & (score <= 100), k).otherwise(value)
    return F.when(score.isNotNull(), value)


def labelled(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("rebound").isNotNull()).withColumn("bin", score_bin(F.col("ice_score")))


def shrunk_bins(rows: DataFrame) -> DataFrame:
    """Each symbol's and bin's hit share, shrunk towards the symbol's base share by PRIOR rows; rows need labelled()."""
    base = rows.groupBy(KEY).agg(((F.sum("rebound") + 1) / (F.count(F.lit(1)) + 2)).alias("base"))
    bins = rows.groupBy(KEY, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("rebound").alias("hits"))
    out = bins.join(base, KEY)
    return out.withColumn("probability", (F.col("hits") + PRIOR * F.col("base")) / (F.col("n") + PRIOR))


def bin_report(rows: DataFrame, least: int = 30) -> DataFrame:
    """Per symbol and bin: n, effective n (overlapping horizons counted once), hits with Wilson bounds, mean returns."""
    n = F.count(F.lit(1))
    out = rows.groupBy(KEY, "bin").agg(n.alias("n"), F.sum("rebound").alias("hits"), F.avg("fwd10").alias("mean_fwd"), F.avg("trade_ret").alias("mean_trade"))
    out = out.withColumn("n_eff", F.floor(F.col("n") / HORIZON))
    share = F.col("hits") / F.col("n")
    low, high = wilson(F.col("hits"), F.col("n"))
    low_e, high_e = wilson(share * F.col("n_eff"), F.col("n_eff"))
    return out.withColumns({"hit_pct": 100 * share, "low": 100 * low, "high": 100 * high, "low_eff": 100 * low_e, "high_eff": 100 * high_e, "usable": F.col("n") >= least})


def regime_split(rows: DataFrame, cold: float = 60.0, least: int = 8) -> DataFrame:
    """Hit shares above and below ma200, of all rows and of cold ones (null under `least`)."""
    out = rows.where(F.col("ma200").isNotNull()).withColumn("above", F.col("close") > F.col("ma200"))
    is_cold = F.col("ice_score") >= cold
    cold_n = F.count_if(is_cold)
    return out.groupBy(KEY, "above").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg("rebound")).alias("hit_pct"), cold_n.alias("cold_n"),
        F.when(cold_n >= least, 100 * F.avg(F.when(is_cold, F.col("rebound")))).alias("cold_hit_pct"),
    )


def walk_forward(rows: DataFrame, horizon: int = HORIZON, least: int = 120) -> DataFrame:
    """Each labelled row's probability and the base share known at its origin: labels of rows horizon + 1 or more before.

    rows: symbol, pos (place in the series), p, rebound. Rows without `least` such labels are left out.
    """
    past = Window.partitionBy(KEY).orderBy("pos").rangeBetween(Window.unboundedPreceding, -(horizon + 1))
    out = rows.where(F.col("rebound").isNotNull() & F.col("p").isNotNull()).withColumns({"_n": F.count("rebound").over(past), "_hits": F.coalesce(F.sum("rebound").over(past), F.lit(0))})
    out = out.where(F.col("_n") >= least)
    return out.withColumn("baseline", (F.col("_hits") + 1) / (F.col("_n") + 2)).drop("_n", "_hits")


def walk_forward_report(evaluated: DataFrame) -> DataFrame:
    """Brier scores of model and baseline, skill, log loss and the number of the 11 interleaved partitions with skill."""
    y = F.col("rebound")
    rows = evaluated.withColumns({"_m": F.pow(F.col("p") - y, 2), "_b": F.pow(F.col("baseline") - y, 2), "_part": F.col("pos") % OVERLAP})
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    rows = rows.withColumn("_log", -(y * F.log(q) + (1 - y) * F.log(1 - q)))
    parts = rows.groupBy(KEY, "_part").agg(F.sum("_m").alias("_m"), F.sum("_b").alias("_b"), F.sum("_log").alias("_log"), F.count(F.lit(1)).alias("_n"))
    out = parts.groupBy(KEY).agg(F.sum("_n").alias("n"), F.sum("_m").alias("_m"), F.sum("_b").alias("_b"), F.sum("_log").alias("_log"), F.count_if(F.col("_m") < F.col("_b")).alias("positive_parts"))
    n = F.col("n")
    return out.select(KEY, "n", F.floor(n / OVERLAP).alias("n_eff"), (F.col("_m") / n).alias("brier"), (F.col("_b") / n).alias("brier_base"), (1 - F.col("_m") / F.nullif(F.col("_b"), F.lit(0.0))).alias("skill"), (F.col("_log") / n).alias("log_loss"), "positive_parts")


def walk_forward_binned(rows: DataFrame, horizon: int = HORIZON, least: int = 120) -> DataFrame:
    """Out-of-sample predictions of bins refitted at each origin from labels that ended before it.

    rows: symbol, pos, bin, rebound. Origins of a symbol lie horizon + 1 places apart or more, earliest first, so that no
    two label windows overlap. Result: symbol, pos, p, baseline, rebound, train_n, bin_n.
    """
    known = rows.where(F.col("rebound").isNotNull() & F.col("bin").isNotNull())
    until = lambda *by: Window.partitionBy(*by).orderBy("pos").rangeBetween(Window.unboundedPreceding, -(horizon + 1))
    count = lambda w: (F.count("rebound").over(w), F.coalesce(F.sum("rebound").over(w), F.lit(0)))
    (n, hits), (bin_n, bin_hits) = count(until(KEY)), count(until(KEY, "bin"))
    out = known.withColumns({"train_n": n, "_hits": hits, "bin_n": bin_n, "_bin_hits": bin_hits}).where(F.col("train_n") >= least)
    out = out.withColumn("baseline", (F.col("_hits") + 1) / (F.col("train_n") + 2))
    out = out.withColumn("p", (F.col("_bin_hits") + PRIOR * F.col("baseline")) / (F.col("bin_n") + PRIOR))
    places = out.groupBy(KEY).agg(F.array_sort(F.collect_list("pos")).alias("_all"))
    apart = lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > horizon), F.concat(a, F.array(x))).otherwise(a)
    origins = places.select(KEY, F.explode(F.aggregate("_all", F.slice("_all", 1, 0), apart)).alias("pos"))
    return out.join(origins, [KEY, "pos"]).select(KEY, "pos", "p", "baseline", "rebound", "train_n", "bin_n")


def binned_report(evaluated: DataFrame, least: int = 60) -> DataFrame:
    """Per symbol: n, Brier scores, skill, log losses and status of walk_forward_binned()."""
    y, n = F.col("rebound"), F.count(F.lit(1))

    def loss(c: str) -> Column:
        q = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), F.col(c)))
        return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))

    out = evaluated.groupBy(KEY).agg(
        n.alias("n"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(F.pow(F.col("baseline") - y, 2)).alias("brier_base"), loss("p").alias("log_loss"), loss("baseline").alias("log_loss_base"),
    )
    skill = 1 - F.col("brier") / F.nullif(F.col("brier_base"), F.lit(0.0))
    out = out.withColumn("skill", skill)
    return out.withColumn("status", F.when(F.col("n") < least, "insufficient_oos").when(F.col("skill") > 0, "positive_oos_skill").otherwise("no_oos_edge"))


def reliability_bucket(p: Column) -> Column:
    value = F.lit(len(RELIABILITY_EDGES) - 2)
    for k in reversed(range(len(RELIABILITY_EDGES) - 2)):
        value = F.when(p < RELIABILITY_EDGES[k + 1], k).otherwise(value)
    return F.when(p.isNotNull(), value)


def reliability_table(evaluated: DataFrame) -> DataFrame:
    """Per symbol and bucket of p: n, effective n, mean prediction and realised share with its Wilson bounds."""
    out = evaluated.groupBy(KEY, reliability_bucket(F.col("p")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("rebound").alias("realised"))
    out = out.withColumn("n_eff", F.floor(F.col("n") / OVERLAP))
    low, high = wilson(F.col("realised") * F.col("n_eff"), F.col("n_eff"))
    return out.withColumns({"low": low, "high": high})


def reliability_interval(latest_p: DataFrame, table: DataFrame) -> DataFrame:
    """Today's p of each symbol with its bucket's realised share and bounds; null where the bucket is empty."""
    return latest_p.withColumn("bucket", reliability_bucket(F.col("p"))).join(table.select(KEY, "bucket", "n", "realised", "low", "high"), [KEY, "bucket"], "left")


def isotonic_curves(points: DataFrame, key: str = KEY, x: str = "bin", y: str = "value", weight: str = "weight") -> DataFrame:
    """points of many short curves with fitted: each key's weighted isotonic fit; points of weight 0 or without a value stay null.

    Points of a key that share an x are one point with their weights added, and get one fit. A pool-adjacent-violators fold over the key's sorted points: a new block takes in the blocks before it that are larger.
    """
    used = points.where((F.col(weight) > 0) & F.col(y).isNotNull())
    used = used.groupBy(key, F.col(x).alias("_x")).agg(F.sum((F.col(y) * F.col(weight)).cast("double")).alias("_s"), F.sum(F.col(weight).cast("double")).alias("_w"))
    row = F.struct(F.col("_x").alias("x"), F.col("_s").alias("s"), F.col("_w").alias("w"))
    rows = used.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_p"))
    # Blocks are walked from the last one: while its mean is larger than the new block's, it is taken in.
    blocks = """aggregate(_p, cast(array() as array<struct<s: double, w: double, xs: array<double>>>), (done, q) ->
      aggregate(reverse(done), named_struct('new', named_struct('s', q.s, 'w', q.w, 'xs', array(cast(q.x as double))), 'left', cast(array() as array<struct<s: double, w: double, xs: array<double>>>)),
        (a, b) -> if(size(a.left) = 0 and b.s / b.w > a.new.s / a.new.w,
          named_struct('new', named_struct('s', b.s + a.new.s, 'w', b.w + a.new.w, 'xs', concat(b.xs, a.new.xs)), 'left', a.left),
          named_struct('new', a.new, 'left', concat(array(b), a.left))),
        a -> concat(a.left, array(a.new))))"""
    fitted = rows.select(key, F.explode(F.expr(blocks)).alias("_b")).select(key, F.explode("_b.xs").alias("_x"), (F.col("_b.s") / F.col("_b.w")).alias("fitted"))
    at = points.withColumn("_x", F.when((F.col(weight) > 0) & F.col(y).isNotNull(), F.col(x).cast("double")))
    return at.join(fitted, [key, "_x"], "left").select(*points.columns, "fitted")


def block_bootstrap(gains: DataFrame, iterations: int = 4000, block: int = OVERLAP) -> DataFrame:
    """Per symbol: share of moving-block bootstrap means that are 0 or less; null under five blocks.

    gains: symbol, pos (0-based, without holes), gain. Draw b of iteration i starts where the MD5 of "i:b" says, which any
    engine can redraw. A symbol's sums of blocks are one array of doubles, which DRAWN iterations at a time look up in a
    fold: no row for an iteration or a draw.
    """
    w = Window.partitionBy(KEY).orderBy("pos").rowsBetween(0, block - 1)
    sums = gains.withColumns({"_sum": F.sum("gain").over(w), "_full": F.count(F.lit(1)).over(w) == block})
    each = sums.groupBy(KEY).agg(F.array_sort(F.collect_list(F.when(F.col("_full"), F.struct("pos", "_sum")))).alias("_all"), F.count(F.lit(1)).alias("n"))
    each = each.where(F.col("n") >= 5 * block).select(KEY, F.transform("_all", lambda s: s["_sum"]).alias("_sums"), F.floor(F.col("n") / block).alias("blocks"))
    parts = each.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(DRAWN))))
    # 15 hexadecimal digits fit a long.
    draw = lambda i, b: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", i.cast("string"), b.cast("string"))), 1, 15), 16, 10).cast("long"), F.size("_sums"))
    total = lambda i: F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("blocks")), F.lit(0.0), lambda a, b: a + F.get("_sums", draw(i, b).cast("int")))
    drawn = F.sequence(F.col("_from"), F.least(F.col("_from") + DRAWN, F.lit(iterations)) - 1)
    below = F.size(F.filter(drawn, lambda i: total(i) <= 0))
    p = parts.repartition(KEY, "_from").select(KEY, below.alias("_below")).groupBy(KEY).agg((F.sum("_below") / iterations).alias("p_value"))
    return gains.select(KEY).distinct().join(p, KEY, "left")


def features(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """All regime features, the cold score, volatility, probability and labels of each bar."""
    out = funding_join(regime_features(bars), funding)
    out = out.withColumn("_before", F.lag("close").over(series()))
    out = run_length(out, F.col("close") < F.col("_before"), "down_run").drop("_before")
    out = forward_labels(blended_volatility(ice_score(ice_ranks(out))))
    return out.withColumn("p", exceedance_probability(F.col("sigma10_pct")))


def predict_latest(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """Newest row of each symbol: p, chance of a fall as large, lift over the base share, missing parts and validity.

    calibration: symbol, asof, base. A calibration of another date makes the row invalid.
    """
    from candela.sources.bars import latest

    rows = latest(scored.select(KEY, "date", "close", "p", "sigma10_pct", "ice_score", *ICE_WEIGHTS))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ICE_WEIGHTS)))
    out = rows.join(calibration.select(KEY, "asof", "base"), KEY, "left")
    ok = F.coalesce(F.col("asof") == F.col("date"), F.lit(False)) & F.col("p").isNotNull()
    return out.select(KEY, "date", "ice_score", F.when(ok, F.col("p")).alias("p"), F.when(ok, F.col("p")).alias("p_drop"), F.when(ok, F.col("p") / F.col("base")).alias("lift"), missing.alias("missing"), F.when(ok, "valid").otherwise("invalid").alias("status"))


