"""Price structure: swing points, gaps, retracement levels, divergences and volume features of each symbol's series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import by_series
from candela.functions.series import lagged, numbers, places
from candela.functions.windows import KEY, from_end, position, rounded, series
from candela.operators import indicators as ind
from candela.operators import normalise as norm

SWING, KEPT_SWINGS, LEAST_SWING = 3, 6, 15
KEPT_GAPS, GAP_UP, GAP_DOWN = 5, 1.002, 0.998
RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
WAVE, LEAST_WAVE, SMALL_WAVE = 120, 20, 5.0
PIVOT_ROWS, PIVOT_GAP, LEAST_PIVOT = 40, 5, 30


def counted(bars: DataFrame) -> DataFrame:
    """bars with i (0-based place) and n (length of the series)."""
    return bars.withColumns({"i": position(), "n": F.count(F.lit(1)).over(Window.partitionBy(KEY))})


def swing_points(bars: DataFrame) -> DataFrame:
    """Rows (symbol, kind, date, price, nth): highs and lows not passed within three bars each side, the last six of each."""
    around = series().rowsBetween(-SWING, SWING)
    marked = counted(bars).withColumns({"_top": F.max("high").over(around), "_bottom": F.min("low").over(around)})
    inside = marked.where((F.col("n") >= LEAST_SWING) & F.col("i").between(SWING, F.col("n") - SWING - 1))
    points = inside.select(KEY, "date", F.explode(F.array_compact(F.array(
        F.when(F.col("high") == F.col("_top"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("low") == F.col("_bottom"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
    ))).alias("p")).select(KEY, "p.kind", "date", "p.price")
    nth = F.row_number().over(Window.partitionBy(KEY, "kind").orderBy(F.desc("date")))
    return points.withColumn("nth", nth).where(F.col("nth") <= KEPT_SWINGS)


def price_gaps(bars: DataFrame) -> DataFrame:
    """Rows (symbol, kind, date, bottom, top, nth): the last five gaps that no later bar has filled."""
    before_high, before_low = F.lag("high").over(series()), F.lag("low").over(series())
    # Rows after this one, as a growing frame from the end: the extremes are running ones.
    later = Window.partitionBy(KEY).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    out = bars.withColumns({"_high": before_high, "_low": before_low, "_later_low": F.min("low").over(later), "_later_high": F.max("high").over(later)})
    up = (F.col("low") > F.col("_high") * GAP_UP) & ~F.coalesce(F.col("_later_low") <= F.col("_high"), F.lit(False))
    down = (F.col("high") < F.col("_low") * GAP_DOWN) & ~F.coalesce(F.col("_later_high") >= F.col("_low"), F.lit(False))
    out = out.withColumn("kind", F.when(up, "UP_GAP").when(down, "DOWN_GAP")).where("kind is not null")
    is_up = F.col("kind") == "UP_GAP"
    out = out.select(KEY, "kind", "date", rounded(F.when(is_up, F.col("_high")).otherwise(F.col("high")), 2).alias("bottom"), rounded(F.when(is_up, F.col("low")).otherwise(F.col("_low")), 2).alias("top"))
    return out.withColumn("nth", from_end()).where(F.col("nth") <= KEPT_GAPS)


def fibonacci_wave(bars: DataFrame) -> DataFrame:
    """One row a symbol: wave_high, wave_low, is_uptrend and the levels (array of ratio and price) of its main wave.

    The wave spans the last 120 bars, or the whole series if its amplitude there is under 5 %.
    """
    rows = counted(bars).where(F.col("n") >= LEAST_WAVE)
    recent = F.col("i") >= F.col("n") - WAVE

    def wave(inside: Column, name: str) -> Column:
        high, low = F.when(inside, F.col("high")), F.when(inside, F.col("low"))
        at_high = F.min_by("i", F.when(inside, F.struct(-F.col("high"), "i")))
        at_low = F.min_by("i", F.when(inside, F.struct(F.col("low"), "i")))
        return F.struct(F.max(high).alias("high"), F.min(low).alias("low"), (at_low < at_high).alias("up")).alias(name)

    both = rows.groupBy(KEY).agg(F.max("n").alias("n"), wave(recent, "near"), wave(F.lit(True), "all"))
    return wave_levels(both)


def wave_levels(both: DataFrame) -> DataFrame:
    """Wave and levels from rows (symbol, n, near, all), the waves as structs (high, low, up)."""
    w = both.select(KEY, main_wave())
    return w.select(KEY, rounded(F.col("w.high"), 2).alias("wave_high"), rounded(F.col("w.low"), 2).alias("wave_low"), F.col("w.up").alias("is_uptrend"), F.array(*(wave_level(r) for r in RATIOS)).alias("levels"))


def main_wave() -> Column:
    """w, the wave of a row with n, near and all."""
    small = ((F.col("near.high") - F.col("near.low")) / (F.col("near.low") + 1e-9) * 100 < SMALL_WAVE) & (F.col("n") > WAVE)
    return F.when(small, F.col("all")).otherwise(F.col("near")).alias("w")


def wave_level(ratio: float) -> Column:
    """Struct (ratio, price) of a level of the wave w."""
    high, low, up = F.col("w.high"), F.col("w.low"), F.col("w.up")
    price = rounded(F.when(up, high - (high - low) * ratio).otherwise(low + (high - low) * ratio), 2)
    return F.struct(F.lit(ratio).alias("ratio"), price.alias("price"))


def _before(last: Column):
    return lambda pivot: last["i"] - pivot["i"] >= PIVOT_GAP


def swing_rows(high, has_high, low, has_low, place, size):
    """Which rows of whole series are highs and lows not passed within three bars each side; NaN is above every number."""
    import numpy as np

    inside = (place >= SWING) & (place < size - SWING)
    same = lambda a, b: (a == b) | (np.isnan(a) & np.isnan(b))
    around = lambda best, x: best.reduce([np.roll(x, k) for k in range(-SWING, SWING + 1)])
    return inside & has_high & same(high, around(np.maximum, np.where(has_high, high, -np.inf))), inside & has_low & same(low, around(np.fmin, low))


def level_marks(bars: DataFrame) -> DataFrame:
    """The rows of bars that swing_points(), price_gaps() or fibonacci_wave() take, from one sort and pass over each series:
    of_high, of_low and of_gap (nth swing or gap from the end, else null), up_gap, high_1 and low_1 (of the bar before), and on
    the newest bar _n, near and all, the waves of wave_levels()."""
    wave = "struct<high:double,low:double,up:boolean>"
    outputs = {"of_high": "int", "of_low": "int", "of_gap": "int", "up_gap": "boolean", "high_1": "double", "low_1": "double", "_n": "bigint", "near": wave, "all": wave}

    def make(table, heads):
        import numpy as np
        import pyarrow as pa

        (high, has_high), (low, has_low) = numbers(table["high"]), numbers(table["low"])
        rows = len(high)
        place, ends = places(heads, rows), np.append(heads[1:], rows)
        size = np.repeat(ends - heads, ends - heads)
        last = ends - 1

        def kept(on, most):
            """nth of the rows from the end of their series, and which are among the last ones."""
            so_far = np.cumsum(on)
            nth = so_far[np.repeat(last, ends - heads)] - so_far + 1
            return pa.array(nth.astype(np.int32), mask=~(on & (nth <= most)))

        # As on Spark NaN is above every number, and a missing value is none.
        above = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))
        tops = np.where(has_high, high, -np.inf)
        later_low, later_high = np.full(rows, np.nan), np.full(rows, -np.inf)
        any_low, any_high = np.zeros(rows, bool), np.zeros(rows, bool)
        with np.errstate(all="ignore"):
            is_high, is_low = (on & (size >= LEAST_SWING) for on in swing_rows(high, has_high, low, has_low, place, size))
            for a, b in zip(heads, ends):
                later_low[a : b - 1] = np.fmin.accumulate(low[b - 1 : a : -1])[::-1]
                later_high[a : b - 1] = np.maximum.accumulate(tops[b - 1 : a : -1])[::-1]
                any_low[a : b - 1] = np.logical_or.accumulate(has_low[b - 1 : a : -1])[::-1]
                any_high[a : b - 1] = np.logical_or.accumulate(has_high[b - 1 : a : -1])[::-1]
            (high_1, has_high_1), (low_1, has_low_1) = lagged(high, has_high, place, 1), lagged(low, has_low, place, 1)
            up = has_low & has_high_1 & above(low, high_1 * GAP_UP) & ~(any_low & ~above(later_low, high_1))
            down = has_high & has_low_1 & above(low_1 * GAP_DOWN, high) & ~(any_high & ~above(low_1, later_high))

        def waves(reach):
            """Extremes of the last rows of each series; the first of equals, and a missing price before all."""
            tall, deep, up_ = np.full(len(heads), np.nan), np.full(len(heads), np.nan), np.zeros(len(heads), bool)
            some = [np.zeros(len(heads), bool), np.zeros(len(heads), bool)]
            for k, b in enumerate(ends):
                at = slice(max(heads[k], b - reach), b)
                h, l, on_h, on_l = high[at], low[at], has_high[at], has_low[at]
                some[0][k], some[1][k] = on_h.any(), on_l.any()
                tall[k], deep[k] = np.maximum.reduce(h, where=on_h, initial=-np.inf), np.fmin.reduce(l)
                first = lambda x, on: np.where(on, np.where(np.isnan(x), np.inf, x), -np.inf).argmin()
                up_[k] = first(l, on_l) < first(-h, on_h)
            item = pa.StructArray.from_arrays([pa.array(tall, mask=~some[0]), pa.array(deep, mask=~some[1]), pa.array(up_)], ["high", "low", "up"])
            return item.take(whose)

        newest = np.zeros(rows, bool)
        newest[last] = True
        whose = pa.array(np.repeat(np.arange(len(heads)), ends - heads), mask=~newest)
        gap = up | down
        return [
            kept(is_high, KEPT_SWINGS), kept(is_low, KEPT_SWINGS), kept(gap, KEPT_GAPS), pa.array(up), pa.array(high_1, mask=~has_high_1), pa.array(low_1, mask=~has_low_1),
            pa.array(size, mask=~newest), waves(WAVE), waves(rows),
        ]

    return by_series(bars.select(KEY, "date", "high", "low"), outputs, make, some=("of_high", "of_low", "of_gap", "_n"))


def marked_swings(marks: DataFrame) -> DataFrame:
    """swing_points() from level_marks()."""
    item = lambda kind: F.when(F.col(f"of_{kind}").isNotNull(), F.struct(F.lit(kind).alias("kind"), "date", F.col(kind).alias("price"), F.col(f"of_{kind}").alias("nth")))
    return marks.select(KEY, F.explode(F.array_compact(F.array(item("high"), item("low")))).alias("s")).select(KEY, "s.*")


def marked_gaps(marks: DataFrame) -> DataFrame:
    """price_gaps() from level_marks()."""
    up = F.col("up_gap")
    bottom, top = F.when(up, F.col("high_1")).otherwise(F.col("high")), F.when(up, F.col("low")).otherwise(F.col("low_1"))
    kind = F.when(up, "UP_GAP").otherwise("DOWN_GAP").alias("kind")
    return marks.where("of_gap is not null").select(KEY, kind, "date", rounded(bottom, 2).alias("bottom"), rounded(top, 2).alias("top"), F.col("of_gap").alias("nth"))


def marked_waves(marks: DataFrame) -> DataFrame:
    """fibonacci_wave() from level_marks()."""
    return wave_levels(marks.where(F.col("_n") >= LEAST_WAVE).select(KEY, F.col("_n").alias("n"), "near", "all"))


def macd_divergence(bars: DataFrame) -> DataFrame:
    """One row a symbol of 30 bars or more: bullish and bearish divergence of price and dif over its last 40 bars.

    Pivots are extremes within three bars each side; the last two bars are compared with those before them alone, and then
    need half as much again. The last pivot is held against the latest one five bars or more before it. Bars need dif, atr.
    """
    found = _pivot_rows(bars).where(F.col("n") >= LEAST_PIVOT)
    return found.select(KEY, "date", "bullish_divergence", "bearish_divergence")


def moving_divergence(marked: DataFrame, rows: int = PIVOT_ROWS, block: int = 4096) -> DataFrame:
    """macd_divergence() of the last `rows` rows at each row with a point, keyed by that point.

    marked: symbol, t (place), point, close, dif and atr. A symbol is cut into blocks of rows, each with the rows - 1 before it,
    so a row is copied for no point.
    """
    mine = F.floor(F.col("t") / block)
    reach = -(-(rows - 1) // block)
    ahead = F.col("t") % block >= block - (rows - 1) if rows - 1 < block else F.lit(True)
    # As on Spark NaN is above every number; a missing value is NaN below.
    value = lambda c: F.when(F.isnan(c), float("inf")).otherwise(F.col(c).cast("double")).alias(c)
    narrow = marked.select(KEY, F.col("t").cast("long").alias("t"), "point", *map(value, ("close", "dif", "atr")), F.explode(F.when(ahead, F.sequence(mine, mine + reach)).otherwise(F.array(mine))).alias("_block"))

    def found(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("t")
        t, point = table["t"].to_numpy(), table["point"].fill_null(0).to_numpy()
        at = np.flatnonzero(table["point"].is_valid().to_numpy() & (t // block == table["_block"].to_numpy()) & (t + 1 >= LEAST_PIVOT))
        bull, bear = pivot_marks(t, at, *(table[c].to_numpy() for c in ("close", "dif", "atr")), rows)
        return pa.table({KEY: point[at], "bullish_divergence": bull, "bearish_divergence": bear})

    return narrow.groupBy(KEY, "_block").applyInArrow(found, f"{KEY} long, bullish_divergence boolean, bearish_divergence boolean")


def pivot_marks(t, at, close, dif, atr, rows: int = PIVOT_ROWS):
    """Bullish and bearish divergence over the last `rows` rows at each of the rows `at`; t: the place of each row in its series,
    which starts in this array or before it. NaN prices are infinite here, missing ones NaN."""
    import numpy as np

    # A row of places for each point, with three missing ones on both sides.
    width, wide = rows + 6, np.arange(-3, rows + 3)
    bull, bear = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for k in range(0, len(at), 512):
        own = at[k : k + 512, None]
        place = own - (rows - 1) + wide
        there = (wide >= 0) & (wide < rows) & (place >= np.maximum(own - t[own], 0))
        c, d = (np.where(there, x[np.clip(place, 0, len(t) - 1)], np.nan) for x in (close, dif))
        m = np.minimum(t[own] + 1, rows)
        i = np.arange(rows) - (rows - m)
        whole, edge = (i >= 2) & (i <= m - 3), (i >= m - 2) & (i >= 0)
        shifted = lambda x, a, b: [x[:, 3 + j : width - 3 + j] for j in range(a, b + 1)]
        eps = np.fmax(0.03, 0.05 * np.where(np.isnan(atr[own]), 0.0, atr[own]))[:, 0]
        now, each = c[:, 3:-3], np.arange(len(own))
        with np.errstate(invalid="ignore"):
            for low, out in ((True, bull), (False, bear)):
                best, passes = (np.fmin, np.less_equal) if low else (np.fmax, np.greater_equal)
                pivot = whole & passes(now, best.reduce(shifted(c, -3, 3))) | edge & passes(now, best.reduce(shifted(c, -3, -1)))
                d1 = best.reduce(shifted(d, -3, 3))
                d2 = np.where(edge, best.reduce(shifted(d, -3, 0)), d1)
                b = rows - 1 - pivot[:, ::-1].argmax(axis=1)
                earlier = pivot & (np.arange(rows) <= b[:, None] - PIVOT_GAP)
                a = rows - 1 - earlier[:, ::-1].argmax(axis=1)
                need = eps * np.where(edge[each, b], 1.5, 1.0)
                if low:
                    on = (now[each, b] <= now[each, a] * 1.01) & (d2[each, b] > d1[each, a] + need)
                else:
                    on = (now[each, b] >= now[each, a] * 0.99) & (d2[each, b] < d1[each, a] - need)
                out[k : k + 512] = on & earlier.any(axis=1)
    return bull, bear


def last_state(frame: DataFrame) -> DataFrame:
    """The newest row of each symbol with n (its number of bars) and the marks of macd_divergence(), in one pass; under
    30 bars the marks are null. A frame with n may hold the last 40 bars alone."""
    found = _pivot_rows(frame)
    sure = lambda c: F.when(F.col("n") >= LEAST_PIVOT, F.col(c)).alias(c)
    return found.select(KEY, "last.*", "n", sure("bullish_divergence"), sure("bearish_divergence"))


def _pivot_rows(bars: DataFrame) -> DataFrame:
    """One row a symbol: n, its newest bar (last) and the two divergences over its last 40 bars."""
    size = F.col("n") if "n" in bars.columns else F.count(F.lit(1)).over(Window.partitionBy(KEY))
    rows = bars.withColumns({"_r": from_end(), "_bars": size}).where(F.col("_r") <= PIVOT_ROWS)
    m = F.least(F.col("_bars"), F.lit(PIVOT_ROWS))
    kept = F.when(F.col("_r") == 1, F.struct(*(c for c in bars.columns if c not in (KEY, "n")))).alias("last")
    rows = rows.select(KEY, "date", "close", "dif", "atr", (m - F.col("_r")).alias("i"), m.alias("m"), F.col("_bars").alias("n"), kept)
    around, left, back = series().rowsBetween(-3, 3), series().rowsBetween(-3, -1), series().rowsBetween(-3, 0)
    whole, edge = F.col("i").between(2, F.col("m") - 3), F.col("i") >= F.col("m") - 2
    eps = F.greatest(F.lit(0.03), 0.05 * F.coalesce(F.max_by("atr", "date").over(Window.partitionBy(KEY)), F.lit(0.0)))
    rows = rows.withColumns({
        "eps": eps, "edge": edge,
        "low": (whole & (F.col("close") <= F.min("close").over(around))) | (edge & (F.col("close") <= F.min("close").over(left))),
        "high": (whole & (F.col("close") >= F.max("close").over(around))) | (edge & (F.col("close") >= F.max("close").over(left))),
        "low_1": F.min("dif").over(around), "low_2": F.when(edge, F.min("dif").over(back)).otherwise(F.min("dif").over(around)),
        "high_1": F.max("dif").over(around), "high_2": F.when(edge, F.max("dif").over(back)).otherwise(F.max("dif").over(around)),
    })

    def pair(kind: str) -> Column:
        pivots = F.array_sort(F.collect_list(F.when(F.col(kind), F.struct("i", "close", "edge", F.col(f"{kind}_1").alias("d1"), F.col(f"{kind}_2").alias("d2")))))
        return pivots.alias(kind)

    # 40 pivots at most for each symbol.
    found = rows.groupBy(KEY).agg(
        F.max("date").alias("date"), F.max("eps").alias("eps"), pair("low"), pair("high"), F.max("n").alias("n"), F.max_by("last", "date").alias("last"),
    )
    for kind in ("low", "high"):
        last = F.try_element_at(kind, F.lit(-1))
        earlier = F.filter(kind, _before(last))
        found = found.withColumns({f"{kind}_b": last, f"{kind}_a": F.try_element_at(earlier, F.lit(-1))})
    need = lambda k: F.col("eps") * F.when(F.col(f"{k}_b.edge"), 1.5).otherwise(1.0)
    bull = (F.col("low_b.close") <= F.col("low_a.close") * 1.01) & (F.col("low_b.d2") > F.col("low_a.d1") + need("low"))
    bear = (F.col("high_b.close") >= F.col("high_a.close") * 0.99) & (F.col("high_b.d2") < F.col("high_a.d1") - need("high"))
    marks = {"bullish_divergence": F.coalesce(bull, F.lit(False)), "bearish_divergence": F.coalesce(bear, F.lit(False))}
    return found.withColumns(marks).select(KEY, "date", "n", "last", *marks)


def day_features(bars: DataFrame, last: int | None = None) -> DataFrame:
    """day_indicators() with change_pct and volume_features(), and _i and _n, place and size of the series."""
    return day_marks(ind.day_indicators(bars, last))


def day_marks(days: DataFrame) -> DataFrame:
    """change_pct and volume_features() of rows that carry the earlier prices of ind.DAY_OUTPUTS."""
    out = norm.change_pct(days, F.col("close_1"))
    return volume_features(out, (F.col("close_3"), F.col("volume_3"))).drop("close_1", "close_3", "volume_3")


def volume_features(bars: DataFrame, earlier: tuple[Column, Column] | None = None) -> DataFrame:
    """Breakout, shrinking pullback and the state of price against volume over three bars; bars need vol_ratio, change_pct.
    earlier: close and volume three bars before, if at hand."""
    v, ratio, change = F.col("volume"), F.col("vol_ratio"), F.col("change_pct")
    close_3, volume_3 = earlier or (F.lag("close", 3).over(series()), F.lag("volume", 3).over(series()))
    up, down, less, more = F.col("close") > close_3, F.col("close") < close_3, v < volume_3 * 0.75, v > volume_3 * 1.3
    return bars.withColumns({
        "is_breakout": (ratio >= 1.8) & (change > 2.0),
        "is_shrink": (ratio < 0.65) & (change > -3.0) & (change < 0.5),
        "vp_state": F.when(up & less, "bearish_vp").when(down & more, "panic").when(down & less, "bullish_vp"),
    })
