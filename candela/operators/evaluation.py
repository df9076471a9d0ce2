"""Point-in-time evaluation: as-of grid, fills, horizon returns, executable exits and pooled statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import by_series
from candela.functions.series import lagged, places
from candela.functions.stats import average_rank, rate_block
from candela.functions.tables import stored
from candela.functions.windows import KEY, position, rounded, series
from candela.operators import indicators as ind
from candela.operators.exits import SWEEP_HORIZONS
from candela.operators.normalise import adjustment_gate, change_pct

HORIZONS, WARMUP, STEP, COST = (5, 10, 20), 250, 3, 1.0
#: Edges of the score groups, names of the flags.
GROUP_EDGES = (0, 40, 50, 60, 70, 80, 101)
FLAGS = ("ma_bull", "ma_bull_full", "ma_bear", "near_ma20", "j_lt45", "j_lt20", "j_gt95", "bt_pattern", "vol_breakout", "shrink_pullback", "macd_gold", "boll_touch_lower", "rsi6_lt20")


def on_grid(warmup: int = WARMUP, step: int = STEP, longest: int = max(HORIZONS)) -> Callable:
    """Which places t of series of n bars asof_grid() takes; for columns or arrays."""
    return lambda t, n: (n >= warmup + longest + 2) & (t >= warmup - 1) & (t <= n - longest - 2) & ((t - (warmup - 1)) % step == 0)


def asof_grid(bars: DataFrame, warmup: int = WARMUP, step: int = STEP, longest: int = max(HORIZONS)) -> DataFrame:
    """bars with t, its place: the rows warmup - 1, then every step-th, that leave `longest` bars and the entry after them."""
    out = bars.withColumns({"t": position(), "_n": F.count(F.lit(1)).over(Window.partitionBy(KEY))})
    return out.where(on_grid(warmup, step, longest)(F.col("t"), F.col("_n"))).drop("_n")


def entry_fill(bars: DataFrame, limit: float = 10.0) -> DataFrame:
    """entry (the next open) and fillable: not if it opens at the limit or has no price."""
    opened = F.lead("open").over(series())
    gap = (opened - F.col("close")) / F.col("close") * 100
    return bars.withColumns({"entry": opened, "fillable": F.coalesce((opened > 0) & (gap < limit - 0.5), F.lit(False))})


def horizon_returns(filled: DataFrame, index: DataFrame | None = None, cost: float = COST) -> DataFrame:
    """ret_h: percent from the entry to the close h bars after it, less costs; null without a fill. With an index: excess_h.

    index: date, close; its return runs between the same two dates and is null where it has no bar. It has a row a date, so it
    is broadcast and no bar is exchanged for it.
    """
    out = filled
    for h in HORIZONS:
        later = F.lead("close", h + 1).over(series())
        out = out.withColumn(f"ret_{h}", F.when(F.col("fillable"), rounded((later - F.col("entry")) / F.col("entry") * 100 - cost, 2)))
    if index is None:
        return out
    return excess_returns(dated(out), index, cost).drop("_from", *(f"_to_{h}" for h in HORIZONS))


def dated(bars: DataFrame) -> DataFrame:
    """bars with _from and _to_h, the dates of the entry and of the close h bars after it."""
    return bars.withColumns({"_from": F.lead("date").over(series()), **{f"_to_{h}": F.lead("date", h + 1).over(series()) for h in HORIZONS}})


def excess_returns(out: DataFrame, index: DataFrame, cost: float = COST) -> DataFrame:
    """out (ret_h, and _from and _to_h, the dates between which they run) with excess_h."""
    base = index.select(F.col("date").alias("_from"), F.col("close").alias("_base"))
    out = out.join(F.broadcast(base), "_from", "left")
    for h in HORIZONS:
        end = index.select(F.col("date").alias(f"_to_{h}"), F.col("close").alias("_end"))
        gain = (F.col("_end") / F.col("_base") - 1) * 100
        out = out.join(F.broadcast(end), f"_to_{h}", "left").withColumn(f"excess_{h}", rounded(F.col(f"ret_{h}") + cost - gain, 2)).drop("_end")
    return out.drop("_base")


def executable_exit(path: Column, stop: Column, horizon: Column | int, limit: float) -> Column:
    """Struct (price, hit) of a path that is at hand as an array: where a position bought at its first open is sold, and
    whether a stop sold it. Over tables of bars, exits.exit_within() needs no path.

    Nothing is sold on the first day, but a low at the stop then leaves an order. On a later day that can be traded (not
    locked at the lower limit, all prices sound), a waiting order is filled at the open, a stop at the smaller of open and
    stop, and an expired position at the close of the due day. Both are null if the path ends first.
    """
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    nil, no = F.lit(None).cast("double"), F.lit(False)
    start = F.struct(F.lit(0).alias("k"), no.alias("stop"), no.alias("due"), nil.alias("before"), nil.alias("price"), F.lit(None).cast("boolean").alias("hit"))
    sound = lambda p: p.isNotNull() & ~F.isnan(p) & (p > 0)

    def step(s: Column, x: Column) -> Column:
        o, h, low, c = x["open"], x["high"], x["low"], x["close"]
        touched = F.coalesce(low <= stop, no)
        valid = sound(o) & (h.isNull() | sound(h)) & sound(low) & sound(c) & sound(s["before"])
        same = lambda a, b: F.abs(a - b) <= 1e-8
        # Without highs a close at the low and at the limit counts as locked.
        locked = (c <= s["before"] * (1 - limit / 100 + 0.001)) & same(low, c) & (h.isNull() | (same(h, low) & same(o, low)))
        trades = (s["k"] > 0) & s["price"].isNull() & F.coalesce(valid & ~locked, no)
        is_due = s["k"] >= horizon
        price = F.when(trades & (s["stop"] | s["due"]), o).when(trades & touched, F.least(o, stop)).when(trades & is_due, c).otherwise(s["price"])
        hit = F.when(trades & (s["stop"] | s["due"]), s["stop"]).when(trades & touched, F.lit(True)).when(trades & is_due, no).otherwise(s["hit"])
        waits = s["stop"] | (touched & ~s["due"])
        return F.struct((s["k"] + 1).alias("k"), waits.alias("stop"), (s["due"] | is_due).alias("due"), c.alias("before"), price.alias("price"), hit.alias("hit"))

    return F.aggregate(path, start, step, lambda s: F.struct(s["price"].alias("price"), s["hit"].alias("hit")))


def sweep_report(swept: DataFrame, entries: DataFrame) -> DataFrame:
    """Per variant and horizon: rate block, censored rows, share of stops among the sold, 5 % quantile, deviation, and the
    mean against no stop; atr_pct is the median ATR of all entries in percent of the close.

    The variant none holds the returns at fixed horizons, which aren't sales: its censored is null. entries: close, atr, ret_h.
    """
    flat = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in SWEEP_HORIZONS)))
    none = entries.select(F.lit("none").alias("variant"), flat.alias("_r")).select("variant", "_r.*", F.lit(False).alias("hit"))
    sold = F.col("ret").isNotNull()
    rates = swept.select("variant", "horizon", "ret", "hit").unionByName(none).groupBy("variant", "horizon").agg(
        *rate_block(F.col("ret"), "ret"), F.count_if(~sold).alias("censored"), (100 * F.avg(F.when(sold, F.col("hit").cast("double")))).alias("stop_hit"),
        F.percentile("ret", F.lit(0.05)).alias("q05"), F.stddev_samp("ret").alias("std"),
    )
    is_none = F.col("variant") == "none"
    # A row for each variant and horizon, so these fit a window.
    base = F.max(F.when(is_none, F.col("ret_mean"))).over(Window.partitionBy("horizon"))
    typical = entries.where("atr > 0").agg(F.median(rounded(F.col("atr") / F.col("close") * 100, 2)).alias("atr_pct"))  # one row
    rates = rates.withColumns({"vs_none": F.col("ret_mean") - base, "censored": F.when(~is_none, F.col("censored"))})
    return rates.crossJoin(F.broadcast(typical))


def flagged_bars(bars: DataFrame, taken: Callable | None = None) -> DataFrame:
    """bars with t (place), kdj_j, rsi_6 and condition_flags(), from one sort of each series; of all bars, or of those whose
    place and length of series taken() accepts."""
    outputs = ind.DAY_OUTPUTS | {"rsi_6": "double", "_hist_1": "double", "_taken": "boolean"}

    def make(table, heads):
        import numpy as np
        import pyarrow as pa

        day = ind.day_arrays(table, heads)
        fast, slow, signal = (x.fill_null(np.nan).to_numpy() for x in day[:3])
        there = table["close"].is_valid().to_numpy()
        size = np.diff(np.append(heads, len(table)))
        place = places(heads, len(table))
        before, has_before = lagged(2 * (fast - slow - signal), there, place, 1)
        ((rsi, full),) = ind.rsi_arrays(table, heads, (6,))
        on = np.ones(len(table), bool) if taken is None else taken(place, np.repeat(size, size))
        return [*day, pa.array(rsi, mask=~full), pa.array(before, mask=~has_before), pa.array(on, mask=~on)]

    rows = ind.day_columns(by_series(bars.drop(*outputs), outputs, make, some=("_taken",)))
    rows = condition_flags(change_pct(rows, F.col("close_1")), F.col("_hist_1"))
    return rows.select(*bars.columns, F.col("_i").alias("t"), "kdj_j", "rsi_6", *FLAGS)


def condition_flags(frame: DataFrame, hist_before: Column | None = None) -> DataFrame:
    """The 13 causal flags of each bar, null-safe; frame: indicators with change_pct. hist_before: hist of the bar before, if at hand."""
    hist_before = F.lag("hist").over(series()) if hist_before is None else hist_before
    c, m20, m60, m120 = (F.col(x) for x in ("close", "ma_20", "ma_60", "ma_120"))
    j, vr, change = F.col("kdj_j"), F.col("vol_ratio"), F.col("change_pct")
    near = (c >= 0.975 * m20) & (c <= 1.03 * m20)
    flags = {
        "ma_bull": (c > m20) & (m20 > m60), "ma_bull_full": (c > m20) & (m20 > m60) & (m60 > m120), "ma_bear": (c < m20) & (m20 < m60), "near_ma20": near,
        "j_lt45": j < 45, "j_lt20": j < 20, "j_gt95": j > 95, "bt_pattern": near & (j < 45) & (m20 >= m60), "vol_breakout": (vr >= 1.8) & (change > 2.0),
        "shrink_pullback": (vr < 0.65) & (change > -3.0) & (change < 0.5), "macd_gold": (F.col("hist") > 0) & (hist_before <= 0),
        "boll_touch_lower": c <= F.col("boll_lower") * 1.01, "rsi6_lt20": F.col("rsi_6") < 20,
    }
    return frame.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def baseline(pit: DataFrame) -> DataFrame:
    """One row: rate blocks of every horizon and the share of entries that can't be filled.

    Where pit has excess_h, also their blocks; where it has path_ret and stop_loss, how many plans that could be entered were
    completed, censored, or not evaluated for want of a stop.
    """
    names = [f"{k}_{h}" for k in ("ret", "excess") for h in HORIZONS if f"{k}_{h}" in pit.columns]
    blocks = [c for x in names for c in rate_block(F.col(x), x)]
    if "path_ret" in pit.columns:
        stops, sold = F.col("stop_loss").isNotNull(), F.col("path_ret").isNotNull()
        counts = {"completed": stops & sold, "censored": stops & ~sold, "not_evaluated": ~stops}
        blocks += [F.count_if(F.col("fillable") & on).alias(c) for c, on in counts.items()]
    return pit.agg(F.count(F.lit(1)).alias("points"), (100 * F.avg((~F.col("fillable")).cast("double"))).alias("unfillable_pct"), *blocks)


def by_group(pit: DataFrame, group: str, horizon: int = 10) -> DataFrame:
    """Rate block of each group, its share of the rows and its lift over all rows, in points of hit rate and of mean."""
    x = f"ret_{horizon}"
    base = pit.agg(*rate_block(F.col(x), "base")).select("base_n", "base_hit", "base_mean")
    out = pit.groupBy(group).agg(*rate_block(F.col(x), "ret")).crossJoin(F.broadcast(base))  # one row
    return out.select(group, *(f"ret_{c}" for c in ("n", "hit", "low", "high", "mean", "median", "pf")), (F.col("ret_hit") - F.col("base_hit")).alias("lift_hit"), (F.col("ret_mean") - F.col("base_mean")).alias("lift_mean"), (100 * F.col("ret_n") / F.col("base_n")).alias("share"))


def by_signal(pit: DataFrame) -> DataFrame:
    """Entries that can be filled by trade signal: rate blocks of every horizon, of the 10-bar excess and of the plan's path,
    the share sold by a stop, the base hit rate of all of them, the lifts over it and over their mean, and the share of rows.
    """
    rows = pit.where("fillable")
    base = rows.agg(F.count(F.lit(1)).alias("_all"), *rate_block(F.col("ret_10"), "base")).select("_all", "base_hit", "base_mean")
    blocks = [c for x in (*(f"ret_{h}" for h in HORIZONS), "excess_10", "path_ret") for c in rate_block(F.col(x), x)]
    stop = 100 * F.avg(F.when(F.col("path_ret").isNotNull(), F.col("path_hit").cast("double")))
    out = rows.groupBy("signal").agg(F.count(F.lit(1)).alias("_n"), *blocks, stop.alias("stop_hit")).crossJoin(F.broadcast(base))  # one row
    out = out.withColumns({f"lift_{c}": F.col(f"ret_10_{c}") - F.col(f"base_{c}") for c in ("hit", "mean")})
    return out.withColumn("share", 100 * F.col("_n") / F.col("_all")).drop("_n", "_all", "base_mean")


def pooled_rank(df: DataFrame, by: str, x: str, name: str) -> DataFrame:
    """df with name: the rank of x (not null) within by, ties averaged, however many rows one value of by has.

    Values are counted first, so what is ordered is one row a value, in range partitions that are stored once.
    """
    values = df.groupBy(by, x).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(by, x).withColumn("_at", F.spark_partition_id())
    values = stored(values, "values")
    parts = values.groupBy(by, "_at").agg(F.sum("_n").alias("_part"))
    earlier = Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(by, "_at", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy(by, "_at").orderBy(x)) - F.col("_n")
    ranks = values.withColumn("_in", inside).join(F.broadcast(before), [by, "_at"])  # a row for each partition and by
    return df.join(ranks.select(by, x, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name)), [by, x])


def spearman(ranked: DataFrame, least: int, *by: str) -> DataFrame:
    """n and ic, the correlation of _rx and _ry, of each group; null under `least` rows or where all ranks are equal."""
    ic = F.covar_pop("_rx", "_ry") / F.nullif(F.stddev_pop("_rx") * F.stddev_pop("_ry"), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, ic).alias("ic"))


def pooled_spearman(rows: DataFrame, least: int = 5) -> DataFrame:
    """n and ic of x and y (neither null) over all rows of each score.

    Ranks of y come from counts of its values. Those of x are taken in range partitions, where the rows move to once and leave
    their sums: ranks lie a constant apart from those within a part, which is the number of rows of the parts before.
    """
    import pyarrow as pa

    ranked = pooled_rank(rows, "score", "y", "_ry").select("score", F.col("x").cast("double").alias("x"), "_ry", F.lit(1).cast("long").alias("_n"))

    def gathered(batches):
        """Rows of one value in a batch are added up, so that a frequent value is few rows."""
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["score", "x"]).aggregate([("_ry", "sum"), ("_n", "sum")])
            yield from sums.select(["score", "x", "_ry_sum", "_n_sum"]).rename_columns(["score", "x", "_ry", "_n"]).to_batches()

    def parts(batches):
        """n, first value, mean ranks within the part, their square and cross sums about the means, of each score of a part."""
        import numpy as np

        so_far = {}
        for batch in batches:
            score = batch.column("score").dictionary_encode()
            codes, x, total, n = score.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("x", "_ry", "_n"))
            for code, name in enumerate(score.dictionary.to_pylist()):
                on = codes == code
                first, before, mx, my, xx, xy = so_far.get(name, (x[on][0], 0, 0.0, 0.0, 0.0, 0.0))
                count = n[on].astype(float)
                own = before + np.cumsum(n[on]) - n[on] + (n[on] + 1) / 2
                size = count.sum()
                ax, ay = (own * count).sum() / size, total[on].sum() / size
                share = before * size / (before + size)
                xx += ((own - ax) ** 2 * count).sum() + (ax - mx) ** 2 * share
                xy += ((own - ax) * (total[on] - ay * count)).sum() + (ax - mx) * (ay - my) * share
                mx, my = mx + (ax - mx) * size / (before + size), my + (ay - my) * size / (before + size)
                so_far[name] = first, before + int(n[on].sum()), mx, my, xx, xy
        if so_far:
            yield pa.RecordBatch.from_arrays([pa.array(list(so_far)), *map(pa.array, zip(*so_far.values()))], names=["score", "first", "n", "mx", "my", "xx", "xy"])

    kind = "score string, x double, _ry double, _n long"
    values = ranked.mapInArrow(gathered, kind).repartitionByRange("score", "x").groupBy("score", "x").agg(F.sum("_ry").alias("_ry"), F.sum("_n").alias("_n"))
    found = values.sortWithinPartitions("score", "x").mapInArrow(parts, "score string, first double, n long, mx double, my double, xx double, xy double")
    # A row a part and score from here on.
    every, w = Window.partitionBy("score"), Window.partitionBy("score").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("mx", F.col("mx") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    mean = lambda c: F.sum(F.col(c) * F.col("n")).over(every) / F.sum("n").over(every)
    found = found.withColumns({"_dx": F.col("mx") - mean("mx"), "_dy": F.col("my") - mean("my")})
    n = F.sum("n")
    sums = found.groupBy("score").agg(n.alias("n"), F.sum(F.col("xx") + F.col("n") * F.col("_dx") * F.col("_dx")).alias("_xx"), F.sum(F.col("xy") + F.col("n") * F.col("_dx") * F.col("_dy")).alias("_xy"))
    spread = ranked.groupBy("score").agg(F.stddev_pop("_ry").alias("_y"))
    ic = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx") * F.col("n")) * F.col("_y"), F.lit(0.0))
    return sums.join(F.broadcast(spread), "score").select("score", "n", F.when(F.col("n") >= least, ic).alias("ic"))


def rank_ic(pit: DataFrame, scores: list[str], ret: str = "ret_10", least_rows: int = 8, least_days: int = 5, excess: str | None = None) -> DataFrame:
    """Per score: rows and pooled Spearman correlation with the return (and with the excess, if named), and the daily ones'
    mean, deviation, their ratio, t value and days."""
    items = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in scores)))

    def melted(y: str, pit: DataFrame = pit) -> DataFrame:
        return pit.select("date", F.col(y).alias("y"), items.alias("s")).select("date", "y", "s.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())

    out = pooled_spearman(melted(ret)).withColumnRenamed("ic", "pooled_ic")
    if excess:
        out = out.join(pooled_spearman(melted(excess)).select("score", F.col("ic").alias("pooled_excess_ic")), "score", "left")
    # A day's rows fit a window; they are dealt by date once, before there is a row for each score.
    dealt = pit.select("date", ret, *scores).where(F.col(ret).isNotNull()).repartition("date")
    by_day = melted(ret, dealt).withColumns({"_rx": average_rank(F.col("x"), "score", "date"), "_ry": average_rank(F.col("y"), "score", "date")})
    daily = spearman(by_day, least_rows, "score", "date").where(F.col("ic").isNotNull())
    days, mean, std = F.count(F.lit(1)), F.avg("ic"), F.stddev_samp("ic")
    ratio = mean / F.nullif(std, F.lit(0.0))
    found = {"mean_ic": mean, "std_ic": std, "icir": ratio, "t": ratio * F.sqrt(days)}
    daily = daily.groupBy("score").agg(days.alias("days"), *(F.when(days >= least_days, v).alias(k) for k, v in found.items()))
    return out.join(daily, "score", "left").withColumn("days", F.coalesce("days", F.lit(0).cast("long")))


def score_quintiles(pit: DataFrame, score: str, ret: str = "ret_10", excess: str | None = None) -> DataFrame:
    """Rate blocks of five equal buckets of the score, ties broken by date and symbol; mean_excess if an excess is named.

    All rows of the score are ordered at once: a global rank, by a range sort and counts of the parts before. The parts are
    fixed once, as counts and ranks must come from the same ones and a second range exchange may cut elsewhere.
    """
    rows = pit.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(KEY, "date", F.col(score).alias("x"), F.col(ret).alias("y"), *([F.col(excess).alias("z")] if excess else []))
    ordered = rows.repartitionByRange("x", "date", KEY).sortWithinPartitions("x", "date", KEY).withColumn("_at", F.spark_partition_id())
    ordered = stored(ordered.withColumn("_in", F.row_number().over(Window.partitionBy("_at").orderBy("x", "date", KEY))), "ordered")
    parts = ordered.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_at", F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = ordered.join(F.broadcast(before), "_at").withColumn("_r", F.col("_before") + F.col("_in"))  # a row a partition
    bucket = F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * 5 / F.nullif(F.col("_all") - 1, F.lit(0)))).cast("int")
    return ranked.groupBy(F.coalesce(bucket, F.lit(1)).alias("quintile")).agg(*rate_block(F.col("y"), "ret"), F.min("x").alias("from_score"), F.max("x").alias("to_score"), *([F.avg("z").alias("mean_excess")] if excess else []))


def score_group(score: Column) -> Column:
    """Label of [0,40), [40,50), ... of a score."""
    out = F.lit(None).cast("string")
    for a, b in zip(GROUP_EDGES, GROUP_EDGES[1:]):
        out = F.when((score >= a) & (score < b), f"{a}-{b}").otherwise(out)
    return out


def score_groups(pit: DataFrame, score: str, ret: str = "ret_10") -> DataFrame:
    """Rate blocks of entries by their score's group, and its mean there."""
    rows = pit.withColumn("group", score_group(F.col(score))).where(F.col("group").isNotNull())
    return rows.groupBy("group").agg(*rate_block(F.col(ret), "ret"), F.avg(F.when(F.col(ret).isNotNull(), F.col(score))).alias("score_mean"))


def condition_base_rates(conditions: DataFrame) -> DataFrame:
    """Per flag, and for the baseline (every row): frequency, rate blocks of every horizon over the rows where it holds, and
    the lifts of the 10-bar hit rate and mean over the baseline's.

    conditions: every bar with all its horizons after it whose entry can be filled.
    """
    named = [(f, F.col(f)) for f in FLAGS] + [("baseline", F.lit(True))]
    items = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), on.alias("on")) for f, on in named)))
    rows = conditions.select(*(f"ret_{h}" for h in HORIZONS), items.alias("f")).select("*", "f.flag", "f.on")
    blocks = [c for h in HORIZONS for c in rate_block(F.when(F.col("on"), F.col(f"ret_{h}")), f"ret_{h}")]
    rates = rows.groupBy("flag").agg((100 * F.avg(F.col("on").cast("double"))).alias("frequency"), *blocks)
    # One row for each flag, so all of them fit a window.
    base = lambda c: F.max(F.when(F.col("flag") == "baseline", F.col(c))).over(Window.partitionBy())
    return rates.withColumns({f"lift_{c}": F.col(f"ret_10_{c}") - base(f"ret_10_{c}") for c in ("hit", "mean")})


def significance_flags(groups: DataFrame, base_hit: float | Column) -> DataFrame:
    """covers_base: the group's Wilson interval holds the base hit rate, so its lift may be chance."""
    base = base_hit if isinstance(base_hit, Column) else F.lit(base_hit)
    return groups.withColumn("covers_base", F.col("ret_low").isNull() | base.between(F.col("ret_low"), F.col("ret_high")))


def doubtful(signals: DataFrame, ics: DataFrame) -> DataFrame:
    """What can't be told from chance (kind, name, value): signals whose interval of the 10-bar hit rate holds the base rate,
    and scores whose daily correlations have |t| under 2. signals: of by_signal; ics: of rank_ic."""
    covered = signals.where(F.col("base_hit").between(F.col("ret_10_low"), F.col("ret_10_high")))
    weak = ics.where(F.abs("t") < 2)
    return covered.select(F.lit("signal").alias("kind"), F.col("signal").alias("name"), F.col("ret_10_hit").alias("value")).unionByName(weak.select(F.lit("score").alias("kind"), F.col("score").alias("name"), F.col("t").alias("value")))


def eligibility(tags: DataFrame, weekly_tags: DataFrame, least: int = WARMUP + max(HORIZONS) + 2) -> DataFrame:
    """One row a symbol: the adjustment gate and the length; tags need bars."""
    return adjustment_gate(tags, weekly_tags).join(tags.select(KEY, "bars"), KEY).withColumn("evaluated", F.col("eligible") & (F.col("bars") >= least))


#: Symbols of slices are symbol * SLICE + t, so a series may have up to SLICE bars.
SLICE = 1_000_000


def asof_slices(bars: DataFrame, lookback: int | None = WARMUP, warmup: int = WARMUP, step: int = 20, longest: int = max(HORIZONS)) -> DataFrame:
    """What each as-of point may know: its last `lookback` bars (None: all up to it), as a series with symbol = symbol * SLICE + t.

    Every operator then works on the slices as on any other series, and can't look ahead. A bar is copied, with no join,
    into each slice that holds it: lookback / step of them, or without a lookback (length of the series - its place) / step.
    A series of SLICE bars or more raises an error.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    rows = bars.withColumns({"_t": position(), "_n": n}).where(F.col("_n") >= warmup + longest + 2)
    rows = rows.withColumn("_n", F.when(F.col("_n") < SLICE, F.col("_n")).otherwise(F.raise_error(F.lit("series too long for slices")).cast("long")))
    until = F.col("_n") - longest - 2
    until = until if lookback is None else F.least(F.col("_t") + lookback - 1, until)
    first = F.greatest(F.lit(0), F.ceil((F.col("_t") - (warmup - 1)) / step)).cast("int")
    last = F.floor((until - (warmup - 1)) / step).cast("int")
    rows = rows.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    key = F.col(KEY).cast("long") * SLICE + (warmup - 1) + F.col("_k") * step
    return rows.withColumn(KEY, key).drop("_t", "_n", "_k")


def support_band_stats(pit: DataFrame) -> DataFrame:
    """Rate blocks of entries near the first support (0 to 2.5 % above it), of those by its stars (s1_stars), and of the others."""
    near = F.coalesce(F.col("s_dist").between(0, 2.5), F.lit(False))
    names = F.when(near, F.array(F.lit("near"), F.concat(F.lit("near_"), F.col("s1_stars").cast("string"), F.lit("_stars")))).otherwise(F.array(F.lit("away")))
    return pit.select("ret_10", F.explode(names).alias("group")).groupBy("group").agg(*rate_block(F.col("ret_10"), "ret"))


def bin_label(x: Column, edges: tuple[float, ...]) -> Column:
    """Label of the bin (low, high] that holds x."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        out = F.when((x > a) & (x <= b), f"({a:g},{b:g}]").otherwise(out)
    return out


def rr_groups(pit: DataFrame) -> DataFrame:
    """Rate blocks of the plan's path return by its gain/loss ratio, and the share sold by a stop."""
    rows = pit.withColumn("group", bin_label(F.col("rr_ratio"), (-1, 0, 1, 2, 3, 100))).where(F.col("group").isNotNull())
    stop = 100 * F.avg(F.when(F.col("path_ret").isNotNull(), F.col("path_hit").cast("double")))
    return rows.groupBy("group").agg(*rate_block(F.col("path_ret"), "ret"), stop.alias("stop_hit"))


def insample_validity(pit: DataFrame, least: int = 30) -> DataFrame:
    """Realised rate blocks by the in-sample win rate (column win_10) with its mean, and the pooled correlation of it with the
    return over all of them; none at all under `least` rows with one."""
    rows = pit.where(F.col("win_10").isNotNull() & F.col("ret_10").isNotNull())
    whole = pooled_spearman(rows.select(F.lit("win_10").alias("score"), F.col("win_10").cast("double").alias("x"), F.col("ret_10").alias("y")))
    enough = whole.where(F.col("n") >= least).select(F.col("ic").alias("pooled_ic"))  # one row or none
    rows = rows.withColumn("group", bin_label(F.col("win_10"), (-1, 50, 60, 70, 101)))
    return rows.groupBy("group").agg(*rate_block(F.col("ret_10"), "ret"), F.avg("win_10").alias("pred_mean")).crossJoin(F.broadcast(enough))
