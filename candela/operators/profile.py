"""Volume by price: each symbol's volume over 100 bins between its lowest low and highest high.

Bin limits are compared in thousandths as integers, so a bar's bins don't depend on a last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.folds import by_series
from candela.functions.windows import KEY, from_end, rounded

BINS, LOOKBACK, PEAK = 100, 250, 0.015
#: Densities have twelve digits; shares of them that bound the middle 70 and 90 %, in units of the last one.
UNITS = 1e12
CUTS = {"_l70": 150_000_000_000, "_h70": 850_000_000_000, "_l90": 50_000_000_000, "_h90": 950_000_000_000}


def _milli(x: str) -> Column:
    return F.round(F.col(x) * 1000).cast("long")


def volume_profile(bars: DataFrame, bins: int = BINS, lookback: int = LOOKBACK, weight: Column | None = None) -> DataFrame:
    """Rows (symbol, bin, centre, density, last_close): densities of a symbol sum to 1; empty bins have no row.

    A bar's volume (or `weight`) is spread over the bins with their centre within its range, more around its middle price;
    a bar between two centres gives all to the bin of its middle price. A bar makes `bins` rows at most, before the sum.
    """
    rows = bars.withColumn("_n", from_end()).where(F.col("_n") <= lookback)
    rows = rows.where((F.col("volume") > 0) & (F.col("volume") < float("inf"))).withColumn("_weight", F.col("volume") if weight is None else weight)
    w = Window.partitionBy(KEY)
    return spread_volume(rows.withColumns({"_close": F.max_by("close", "date").over(w), "_low": F.min(_milli("low")).over(w), "_high": F.max(_milli("high")).over(w)}), bins)


def spread_volume(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """The profile of bars that carry _weight and, the same on all bars of a key, _close, _low and _high (in thousandths)."""
    low, high = F.col("_low"), F.col("_high")
    flat = low == high
    rows = rows.withColumns({"_lo": F.when(flat, low * 0.9).otherwise(low).cast("long"), "_hi": F.when(flat, high * 1.1).otherwise(high).cast("long")})
    d, size = F.col("_hi") - F.col("_lo"), 2 * bins
    first = F.ceil((size * (_milli("low") - F.col("_lo")) - d) / (2 * d)).cast("int")
    last = F.floor((size * (_milli("high") - F.col("_lo")) - d) / (2 * d)).cast("int")
    middle = _milli("open") + _milli("close") + _milli("high") + _milli("low")
    point = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((middle - 4 * F.col("_lo")) * bins / (4 * d)) - 1)).cast("int")
    rows = rows.withColumns({"_first": F.when(first <= last, F.greatest(first, F.lit(0))).otherwise(point), "_last": F.when(first <= last, F.least(last, F.lit(bins - 1))).otherwise(point)})
    centre = lambda b: (F.col("_lo") + (b + 0.5) * d / bins) / 1000
    mid, width = (F.col("open") + F.col("close") + F.col("high") + F.col("low")) / 4, F.greatest(F.col("high") - F.col("low"), F.lit(0.01))
    near = lambda b: F.greatest(F.lit(0.1), 1 - F.abs(centre(b) - mid) / width)
    spread = F.transform(F.sequence("_first", "_last"), lambda b: F.struct(b.alias("bin"), centre(b).alias("centre"), near(b).alias("near")))
    rows = rows.select(KEY, "_close", "_weight", spread.alias("_s"))
    rows = rows.withColumn("_total", F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["near"]))
    each = rows.select(KEY, "_close", F.explode("_s").alias("s"), "_weight", "_total")
    sums = each.groupBy(KEY, F.col("s.bin").alias("bin")).agg(F.max("s.centre").alias("centre"), F.max("_close").alias("last_close"), F.sum(F.col("_weight") * F.col("s.near") / F.col("_total")).alias("_d"))
    total = F.sum("_d").over(Window.partitionBy(KEY))
    return sums.select(KEY, "bin", "centre", F.round(F.col("_d") / F.nullif(total, F.lit(0.0)), 12).alias("density"), "last_close")


def moving_profile(marked: DataFrame, bins: int = BINS, lookback: int = LOOKBACK, block: int = 4096) -> DataFrame:
    """The profile of the last `lookback` rows at each row with a point, keyed by that point; marked: see _at_points()."""
    schema = {KEY: "long", "bin": "int", "centre": "double", "_d": "double", "last_close": "double"}

    def cells(point, sums, used, centre, close):
        import numpy as np
        import pyarrow as pa

        of, b = np.nonzero(used)
        return [pa.array(x, from_pandas=True) for x in (point[of], b.astype(np.int32), centre[of, b], sums[of, b], close[of])]

    total = F.sum("_d").over(Window.partitionBy(KEY))
    density = F.round(F.col("_d") / F.nullif(total, F.lit(0.0)), 12)
    return _at_points(marked, bins, lookback, block, schema, cells).select(KEY, "bin", "centre", density.alias("density"), "last_close")


def moving_profile_state(marked: DataFrame, bins: int = BINS, lookback: int = LOOKBACK, block: int = 4096) -> DataFrame:
    """profile_state() of the moving profile at each point, taken where the profile is made: a point leaves one row, not its bins."""
    found = _at_points(marked, bins, lookback, block, _STATE, _marks)
    return _point_state(found)


def newest_profile_state(bars: DataFrame, bins: int = BINS, lookback: int = LOOKBACK) -> DataFrame:
    """profile_state() of the newest `lookback` bars of each symbol, many symbols at a time, in one sort of the bars."""
    import pyarrow as pa

    outputs = {c: kind for c, kind in _STATE.items() if c != KEY}
    spread = _spreader(bins, lookback, 1, _STATE, _marks)

    def make(table, heads):
        import numpy as np

        rows, ends = len(table), np.append(heads[1:], len(table))
        # Series lie lookback rows apart, so that none reaches into another.
        t = np.arange(rows) + lookback * np.repeat(np.arange(len(heads)), ends - heads)
        newest = np.zeros(rows, bool)
        newest[ends - 1] = True
        placed = table.select(["sound", *_OWN]).append_column("t", pa.array(t)).append_column("_block", pa.array(t))
        found = spread(placed.append_column("point", pa.array(np.arange(rows), mask=~newest)))
        of = np.full(rows, -1)
        of[found[KEY].to_numpy()] = np.arange(len(found))
        at = pa.array(of, mask=of < 0)
        return [found[c].combine_chunks().take(at) for c in outputs]

    recent = bars.withColumn("_left", from_end()).where(F.col("_left") <= lookback)
    rows = by_series(recent.select(KEY, "date", *profiled_columns()), outputs, make, some=("_profit",))
    return _point_state(rows.select(KEY, *outputs))


def _point_state(found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    out = found.select(*(keep or [KEY]), rounded(F.col("_poc"), 2).alias("poc"), rounded(F.col("_profit"), 2).alias("profit_ratio"), "_c", *CUTS, "peaks")
    return _widths(out)


#: What a profile leaves of a point, and what it takes from a sound bar.
_STATE = {KEY: "long"} | dict.fromkeys(("_poc", "_profit", "_c", *CUTS), "double") | {"peaks": "array<struct<bin:int,centre:double,density:double>>"}
_OWN = ("m0", "m1", "middle", "mid", "width", "close", "weight")


def _marks(point, sums, used, centre, close):
    import numpy as np
    import pyarrow as pa

    rows, total = np.arange(len(point)), np.cumsum(sums, axis=1)[:, -1:]
    known = used & (total != 0)
    units = np.where(known, np.floor(sums / np.where(total == 0, 1.0, total) * UNITS + 0.5), 0.0)
    density = np.where(used & ~known, np.nan, units / UNITS)
    so_far = np.cumsum(units.astype(np.int64), axis=1)

    def first(where):
        return np.where(where.any(axis=1), centre[rows, where.argmax(axis=1)], np.nan)

    poc = centre[rows, np.where(used, density, -1.0).argmax(axis=1)]
    profit = np.where(used & (centre <= close[:, None]), units, 0.0).sum(axis=1) / (UNITS / 100)
    peak = np.zeros_like(used)
    inside = density[:, 1:-1]
    peak[:, 1:-1] = used[:, 1:-1] & (inside > density[:, :-2]) & (inside > density[:, 2:]) & (inside > PEAK)
    of, b = np.nonzero(peak)
    item = [pa.array(x, from_pandas=True) for x in (b.astype(np.int32), centre[of, b], density[of, b])]
    peaks = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(peak.sum(axis=1))]).astype(np.int32), pa.StructArray.from_arrays(item, ["bin", "centre", "density"]))
    return [pa.array(x, from_pandas=True) for x in (point, poc, profit, close, *(first(used & (so_far >= x)) for x in CUTS.values()))] + [peaks]


def _at_points(marked: DataFrame, bins: int, lookback: int, block: int, schema: dict[str, str], give) -> DataFrame:
    """What give() makes of the volume by bin at some points at a time: of their keys and newest closes and, a row a point and
    a column a bin, of volumes, which bins are used, and centres.

    schema: columns and types of its arrays. marked: symbol, t (place), point, sound, and of sound rows m0, m1 (low and high in thousandths), middle (sum of the four
    prices in thousandths), mid, width, close and weight. A symbol is cut into blocks of rows, each with the lookback - 1
    rows before it, and the bars of some points at a time are spread over their bins.
    """
    mine = F.floor(F.col("t") / block)
    reach = -(-(lookback - 1) // block)
    ahead = F.col("t") % block >= block - (lookback - 1) if lookback - 1 < block else F.lit(True)
    rows = marked.withColumn("_block", F.explode(F.when(ahead, F.sequence(mine, mine + reach)).otherwise(F.array(mine))))
    return rows.groupBy(KEY, "_block").applyInArrow(_spreader(bins, lookback, block, schema, give), ", ".join(f"{c} {kind}" for c, kind in schema.items()))


def profiled_columns() -> list[Column]:
    """What a profile takes from each bar: sound, and of sound bars the columns of _at_points()."""
    sound = F.coalesce((F.col("volume") > 0) & (F.col("volume") < float("inf")), F.lit(False))
    milli = {"m0": _milli("low"), "m1": _milli("high"), "middle": _milli("open") + _milli("close") + _milli("high") + _milli("low")}
    own = milli | {"mid": (F.col("open") + F.col("close") + F.col("high") + F.col("low")) / 4, "width": F.greatest(F.col("high") - F.col("low"), F.lit(0.01)), "close": F.col("close"), "weight": F.col("volume").cast("double")}
    return [sound.alias("sound"), *(F.when(sound, x.cast("long" if c in milli else "double")).alias(c) for c, x in own.items())]


def _spreader(bins: int, lookback: int, block: int, schema: dict[str, str], give):
    """The step of _at_points() on the bars of one block."""

    def spread(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("t")
        column = lambda c, kind: table[c].cast(kind).to_numpy()
        whole = lambda c: table[c].fill_null(0).to_numpy()
        missing = lambda c: table[c].is_null().to_numpy()
        t, sound = table["t"].to_numpy(), table["sound"].to_numpy()
        at = np.flatnonzero(~missing("point") & (t // block == table["_block"].to_numpy()))
        bar = np.flatnonzero(sound)
        m0, m1, middle = (whole(c)[bar] for c in ("m0", "m1", "middle"))
        no_low, no_high, no_middle = (missing(c)[bar] for c in ("m0", "m1", "middle"))
        mid, width, close, weight = (column(c, pa.float64())[bar] for c in ("mid", "width", "close", "weight"))
        point = whole("point")
        known = np.maximum.accumulate(np.where(np.isnan(close), -1, np.arange(len(bar)))) if len(bar) else bar
        top = np.iinfo(np.int64).max
        floor, ceiling = np.where(no_low, top, m0), np.where(no_high, -top, m1)
        start = np.searchsorted(t[bar], t[at] - (lookback - 1))
        end = np.searchsorted(t[bar], t[at], side="right")
        at, start, end = (x[end > start] for x in (at, start, end))
        out = []
        for k in range(0, len(at), 64):
            first_, n = start[k : k + 64], (end - start)[k : k + 64]
            own = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_, n)
            heads = np.cumsum(n) - n
            lo, hi = np.minimum.reduceat(floor[i], heads), np.maximum.reduceat(ceiling[i], heads)
            unknown = (lo == top) | (hi == -top)
            lo, hi = np.where(unknown, 0, lo), np.where(unknown, 1, hi)
            flat = lo == hi
            lo, hi = np.where(flat, (lo * 0.9).astype(np.int64), lo), np.where(flat, (hi * 1.1).astype(np.int64), hi)
            d = hi - lo
            if not d.all():
                raise ZeroDivisionError("the prices of a profile are all zero")
            size, de, le = 2 * bins, d[own], lo[own]
            first = np.ceil((size * (m0[i] - le) - de) / (2 * de)).astype(np.int64)
            last = np.floor((size * (m1[i] - le) - de) / (2 * de)).astype(np.int64)
            spot = np.clip(np.ceil((middle[i] - 4 * le) * bins / (4 * de)) - 1, 0, bins - 1).astype(np.int64)
            spot = np.where(no_middle[i] | unknown[own], bins - 1, spot)
            wide = (first <= last) & ~(no_low[i] | no_high[i] | unknown[own])
            first, last = np.where(wide, np.maximum(first, 0), spot), np.where(wide, np.minimum(last, bins - 1), spot)
            count = last - first + 1
            each = np.repeat(np.arange(len(i)), count)
            b = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
            of, x = own[each], i[each]
            centre = (lo[of] + (b + 0.5) * d[of] / bins) / 1000
            near = np.fmax(0.1, 1 - np.abs(np.where(unknown[of], np.nan, centre) - mid[x]) / width[x])
            total = np.bincount(each, near, len(i))
            cell = of * bins + b
            sums, used = np.bincount(cell, weight[x] * near / total[each], len(n) * bins), np.bincount(cell, minlength=len(n) * bins)
            newest = known[end[k : k + 64] - 1]
            price = np.where(newest >= first_, close[np.maximum(newest, 0)], np.nan)
            centres = np.where(unknown[:, None], np.nan, (lo[:, None] + (np.arange(bins) + 0.5) * d[:, None] / bins) / 1000)
            out.append(pa.table(give(point[at[k : k + 64]], sums.reshape(-1, bins), used.reshape(-1, bins) > 0, centres, price), names=list(schema)))
        none = np.empty((0, bins))
        return pa.concat_tables(out) if out else pa.table(give(point[:0], none, none > 0, none, close[:0]), names=list(schema))

    return spread


def turnover_weight(bars: DataFrame, by: str = "date") -> DataFrame:
    """bars with decay_weight: what of a bar's turnover no later turnover has replaced; limit days inject 0.3.

    Only series with a reliable, historical turnover within 0..100 on every bar are kept.
    """
    sound = F.min(F.when((F.col("provenance") == "reliable/historical") & F.col("turnover").between(0, 100), 1).otherwise(0)).over(Window.partitionBy(KEY))
    rows = bars.withColumns({"_sound": sound, "_turn": F.least(F.col("turnover") / 100, F.lit(0.5))}).where(F.col("_sound") == 1)
    later = Window.partitionBy(KEY).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    kept = F.exp(F.coalesce(F.sum(F.log1p(-F.col("_turn"))).over(later), F.lit(0.0)))
    inject = F.when(F.col("is_limit_up") | F.col("is_limit_down"), 0.3).otherwise(1.0)
    return rows.withColumn("decay_weight", F.col("_turn") * inject * kept).drop("_sound", "_turn")


def turnover_decay_profile(bars: DataFrame, bins: int = BINS, lookback: int = LOOKBACK) -> DataFrame:
    """volume_profile() of the decay weights over the last `lookback` bars."""
    recent = bars.withColumn("_r", from_end()).where(F.col("_r") <= lookback).drop("_r")
    return volume_profile(turnover_weight(recent), bins, lookback, F.col("decay_weight"))


def profile_poc(profile: DataFrame) -> DataFrame:
    """The densest bin's centre, the lowest of equals."""
    return profile.groupBy(KEY).agg(_densest())


def _densest() -> Column:
    return rounded(F.min_by("centre", F.struct(-F.col("density"), "bin")), 2).alias("poc")


def profile_peaks(profile: DataFrame) -> DataFrame:
    """Interior bins above both neighbours (an empty one is 0) and above PEAK."""
    w = Window.partitionBy(KEY).orderBy("bin").rangeBetween(-1, -1), Window.partitionBy(KEY).orderBy("bin").rangeBetween(1, 1)
    left, right = (F.coalesce(F.max("density").over(x), F.lit(0.0)) for x in w)
    out = profile.withColumns({"_left": left, "_right": right})
    return out.where(_is_peak()).select(KEY, "bin", "centre", "density")


def _is_peak() -> Column:
    density = F.col("density")
    return F.col("bin").between(1, BINS - 2) & (density > F.col("_left")) & (density > F.col("_right")) & (density > PEAK)


def profit_ratio(profile: DataFrame) -> DataFrame:
    """Percent of the density at centres up to the last close."""
    return profile.groupBy(KEY).agg(_in_profit())


def _in_profit() -> Column:
    below = F.sum(F.when(F.col("centre") <= F.col("last_close"), _units()))
    return rounded(F.coalesce(below, F.lit(0)) / (UNITS / 100), 2).alias("profit_ratio")


def concentration(profile: DataFrame) -> DataFrame:
    """Ranges that hold the middle 70 and 90 % of the density, their width in percent of the close, and the single-peak flag."""
    return _widths(profile.withColumn("_cum", _running()).groupBy(KEY).agg(*_cuts()))


def _units() -> Column:
    """A density, which has twelve digits, as an integer: sums of it are exact, so no limit is missed by a last bit."""
    return F.rint(F.col("density") * UNITS).cast("long")


def _running() -> Column:
    return F.sum(_units()).over(Window.partitionBy(KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))


def _cuts() -> list[Column]:
    cut = lambda x: F.min(F.when(F.col("_cum") >= x, F.col("centre")))
    return [F.max("last_close").alias("_c"), *(cut(x).alias(n) for n, x in CUTS.items())]


def _widths(out: DataFrame) -> DataFrame:
    wide = lambda p: rounded((F.col(f"_h{p}") - F.col(f"_l{p}")) / (F.col("_c") + 1e-9) * 100, 2)
    edge = {f"{e}_{p}": rounded(F.col(f"_{e[0]}{p}"), 2) for p in (70, 90) for e in ("low", "high")}
    return out.withColumns({"conc_70": wide(70), "conc_90": wide(90), **edge}).withColumn("single_peak", F.col("conc_90") < 10).drop("_c", "_l70", "_h70", "_l90", "_h90")


def profile_state(profile: DataFrame) -> DataFrame:
    """One row a symbol from one pass over its bins: poc, profit_ratio, concentration, and peaks (array of bin, centre, density)."""
    around = Window.partitionBy(KEY).orderBy("bin")
    near = lambda k: F.coalesce(F.max("density").over(around.rangeBetween(k, k)), F.lit(0.0))
    rows = profile.withColumns({"_cum": _running(), "_left": near(-1), "_right": near(1)})
    peaks = F.array_sort(F.collect_list(F.when(_is_peak(), F.struct("bin", "centre", "density")))).alias("peaks")
    return _widths(rows.groupBy(KEY).agg(_densest(), _in_profit(), *_cuts(), peaks))


def profile_summary(profile: DataFrame) -> DataFrame:
    """One row a symbol: poc, profit_ratio and concentration."""
    return profile_state(profile).drop("peaks")
