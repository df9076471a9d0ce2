"""Queries over price structure, volume profiles and levels, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candela.functions.windows import position
from candela.operators import indicators as ind
from candela.operators import levels as lev
from candela.operators import normalise as norm
from candela.operators import profile as prof
from candela.operators import structure as st
from candela.plans import catalog_bars as cb
from candela.plans import fixtures
from candela.plans.catalog_bars import ATR, B, BOLL, BR, CHANGE, LIMITS, SMA, VR, WEEKLY, daily, mean_sql, portable, query
from candela.plans.fixtures import DAILY, EVENT_DAILY, HOURLY

_LOCAL = set(cb.QUERIES)

SWINGS = portable("""
sw as (select *, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n,
              max(high) over w as top, min(low) over w as bottom from bars window w as (partition by symbol order by date rows between 3 preceding and 3 following)),
swings as (select symbol, kind, date, price, row_number() over (partition by symbol, kind order by date desc) as nth from (
  select symbol, 'high' as kind, date, high as price from sw where n >= 15 and i between 3 and n - 4 and high = top
  union all select symbol, 'low', date, low from sw where n >= 15 and i between 3 and n - 4 and low = bottom) _s qualify nth <= 6)""")


@query("x1_swings", f"{B}, {SWINGS} select * from swings")
def _(spark, d):
    return st.swing_points(daily(spark, d))


GAPS = portable("""
gp as (select *, lag(high) over w as ph, lag(low) over w as pl, min(low) over (partition by symbol order by date rows between 1 following and unbounded following) as ll,
              max(high) over (partition by symbol order by date rows between 1 following and unbounded following) as lh from bars window w as (partition by symbol order by date)),
gaps as (select symbol, kind, date, bottom, top, row_number() over (partition by symbol order by date desc) as nth from (
  select symbol, 'UP_GAP' as kind, date, round(ph, 2) as bottom, round(low, 2) as top from gp where low > ph * 1.002e0 and not coalesce(ll <= ph, false)
  union all select symbol, 'DOWN_GAP', date, round(high, 2), round(pl, 2) from gp where high < pl * 0.998e0 and not coalesce(lh >= pl, false)) _g qualify nth <= 5)""")


@query("x2_gaps", f"{B}, {GAPS} select * from gaps")
def _(spark, d):
    return st.price_gaps(daily(spark, d))


WAVES = portable("""
fb as (select *, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n from bars),
fa as (select symbol, n, max(high) as ah, min(low) as al, min(case when low = ml then i end) < min(case when high = mh then i end) as au
       from (select *, max(high) over (partition by symbol) as mh, min(low) over (partition by symbol) as ml from fb) _a where n >= 20 group by symbol, n),
fr as (select symbol, max(high) as rh, min(low) as rl, min(case when low = ml then i end) < min(case when high = mh then i end) as ru
       from (select *, max(high) over (partition by symbol) as mh, min(low) over (partition by symbol) as ml from fb where i >= n - 120) _r group by symbol),
fw as (select symbol, case when small then ah else rh end as h, case when small then al else rl end as l, case when small then au else ru end as up
       from (select *, (rh - rl) / (rl + 1e-9) * 100 < 5 and n > 120 as small from fa join fr using (symbol)) _w),
fib as (select symbol, r as ratio, round(case when up then h - (h - l) * r else l + (h - l) * r end, 2) as price, round(h, 2) as wave_high, round(l, 2) as wave_low, up as is_uptrend
        from fw, (select unnest([0e0, 0.236e0, 0.382e0, 0.5e0, 0.618e0, 0.786e0, 1e0]) as r) _r)""")


@query("x3_fibonacci", f"{B}, {WAVES} select * from fib")
def _(spark, d):
    return st.fibonacci_wave(daily(spark, d)).select("symbol", "wave_high", "wave_low", "is_uptrend", F.explode("levels").alias("l")).select("symbol", "l.*", "wave_high", "wave_low", "is_uptrend")


DIVERGENCE = f"""
atrs as materialized (select symbol, date, atr, tr from {ATR} _a),
dv as (select b.symbol, b.date, close, dif, atr, row_number() over (partition by b.symbol order by b.date desc) as r, count(*) over (partition by b.symbol) as n from bars b join rec using (symbol, date) join atrs using (symbol, date)),
dw as (select *, least(n, 40) - r as i, least(n, 40) as m, greatest(0.03e0, 0.05e0 * max_by(atr, date) over (partition by symbol)) as eps from dv where r <= 40 and n >= 30),
dx as (select *, (i between 2 and m - 3 and close <= min(close) over a) or (i >= m - 2 and close <= min(close) over l) as lo, (i between 2 and m - 3 and close >= max(close) over a) or (i >= m - 2 and close >= max(close) over l) as hi,
         i >= m - 2 as edge, min(dif) over a as l1, case when i >= m - 2 then min(dif) over k else min(dif) over a end as l2, max(dif) over a as h1, case when i >= m - 2 then max(dif) over k else max(dif) over a end as h2
       from dw window a as (partition by symbol order by date rows between 3 preceding and 3 following), l as (partition by symbol order by date rows between 3 preceding and 1 preceding), k as (partition by symbol order by date rows between 3 preceding and current row)),
lb as (select * from dx where lo qualify row_number() over (partition by symbol order by i desc) = 1), hb as (select * from dx where hi qualify row_number() over (partition by symbol order by i desc) = 1),
la as (select dx.* from dx join lb using (symbol) where dx.lo and lb.i - dx.i >= 5 qualify row_number() over (partition by symbol order by dx.i desc) = 1),
ha as (select dx.* from dx join hb using (symbol) where dx.hi and hb.i - dx.i >= 5 qualify row_number() over (partition by symbol order by dx.i desc) = 1),
divergence as (select s.symbol, s.date,
    coalesce(lb.close <= la.close * 1.01e0 and lb.l2 > la.l1 + s.eps * case when lb.edge then 1.5e0 else 1e0 end, false) as bullish_divergence,
    coalesce(hb.close >= ha.close * 0.99e0 and hb.h2 < ha.h1 - s.eps * case when hb.edge then 1.5e0 else 1e0 end, false) as bearish_divergence
  from (select symbol, max(date) as date, max(eps) as eps from dw group by symbol) s left join lb using (symbol) left join la using (symbol) left join hb using (symbol) left join ha using (symbol))"""


@query("x4_divergence", f"{BR}, {DIVERGENCE} select * from divergence")
def _(spark, d):
    return st.macd_divergence(ind.recursions(ind.atr(daily(spark, d))))


FEATURES = f"""
vf as (select *, lag(close, 3) over (partition by symbol order by date) as c3, lag(volume, 3) over (partition by symbol order by date) as v3
       from (select symbol, date, close, volume, change_pct from {CHANGE} _c) c join (select symbol, date, vol_ratio from {VR} _v) v using (symbol, date)),
features as (select symbol, date, vol_ratio >= 1.8e0 and change_pct > 2 as is_breakout, vol_ratio < 0.65e0 and change_pct > -3 and change_pct < 0.5e0 as is_shrink,
    case when close > c3 and volume < v3 * 0.75e0 then 'bearish_vp' when close < c3 and volume > v3 * 1.3e0 then 'panic' when close < c3 and volume < v3 * 0.75e0 then 'bullish_vp' end as vp_state from vf)"""


@query("x5_volume_features", f"{B}, {FEATURES} select * from features")
def _(spark, d):
    return st.volume_features(ind.vol_ratio(norm.change_pct(daily(spark, d)))).select("symbol", "date", "is_breakout", "is_shrink", "vp_state")


def profile_cte(bars: str, weight: str, name: str) -> str:
    return f"""
{name}0 as (select *, round(low*1000)::bigint as lm, round(high*1000)::bigint as hm, round(open*1000)::bigint + round(close*1000)::bigint + round(high*1000)::bigint + round(low*1000)::bigint as mm, {weight} as wt
  from (select * from {bars} qualify row_number() over (partition by symbol order by date desc) <= 250) _b where volume > 0),
{name}1 as (select *, max_by(close, date) over p as lc, case when min(lm) over p = max(hm) over p then floor(min(lm) over p * 0.9e0) else min(lm) over p end::bigint as lo,
  case when min(lm) over p = max(hm) over p then floor(max(hm) over p * 1.1e0) else max(hm) over p end::bigint as hi from {name}0 window p as (partition by symbol)),
{name}2 as (select *, hi - lo as d, ceil((200*(lm - lo) - (hi - lo)) / (2*(hi - lo)))::int as f, floor((200*(hm - lo) - (hi - lo)) / (2*(hi - lo)))::int as l, greatest(0, least(99, ceil((mm - 4*lo)*100 / (4*(hi - lo)))::int - 1)) as pt from {name}1),
{name}3 as (select *, unnest(range(case when f <= l then greatest(f, 0) else pt end, case when f <= l then least(l, 99) else pt end + 1))::int as bin from {name}2),
{name}4 as (select *, greatest(0.1e0, 1 - abs(centre - (open + close + high + low)/4) / greatest(high - low, 0.01e0)) as near from (select *, (lo + (bin + 0.5e0)*d/100)/1000 as centre from {name}3) _c),
{name}5 as (select symbol, bin, max(centre) as centre, max(lc) as last_close, sum(share) as ds from (select *, wt*near/sum(near) over (partition by symbol, date) as share from {name}4) _s group by symbol, bin),
{name} as materialized (select symbol, bin, centre, round(ds/sum(ds) over (partition by symbol), 12) as density, last_close from {name}5)"""


PROFILE = profile_cte("bars", "volume", "profile")
DECAY = """
tv as (select *, least(volume/20, 50e0) as turnover from limits),
tw as (select *, least(turnover/100, 0.5e0) as turn from tv where symbol % 7 <> 0 qualify row_number() over (partition by symbol order by date desc) <= 250),
td as (select *, turn * case when is_limit_up or is_limit_down then 0.3e0 else 1e0 end * exp(coalesce(sum(ln(1 - turn)) over (partition by symbol order by date rows between 1 following and unbounded following), 0)) as decay from tw)"""


def profile(spark, d):
    return prof.volume_profile(daily(spark, d))


@query("v1_profile", f"{B}, {PROFILE} select symbol, bin, centre, round(density, 9) as density from profile", "centre")
def _(spark, d):
    return profile(spark, d).select("symbol", "bin", "centre", F.round("density", 9).alias("density"))


@query("v2_decay_profile", f"{B}, limits as (select * from {LIMITS} _l), {DECAY}, {profile_cte('td', 'decay', 'profile')} select symbol, bin, centre, round(density, 9) as density from profile", "centre")
def _(spark, d):
    bars = norm.limit_flags(norm.change_pct(daily(spark, d)), F.lit(1.5))
    bars = bars.withColumns({"turnover": F.least(F.col("volume") / 20, F.lit(50.0)), "provenance": F.expr("case when symbol % 7 = 0 then 'estimated/current' else 'reliable/historical' end")})
    return prof.turnover_decay_profile(bars).select("symbol", "bin", "centre", F.round("density", 9).alias("density"))


SUMMARY = portable("""
poc as (select symbol, round(centre, 2) as poc from profile qualify row_number() over (partition by symbol order by density desc, bin) = 1),
peaks as (select symbol, bin, centre, density from (select *, coalesce(max(density) over (partition by symbol order by bin range between 1 preceding and 1 preceding), 0) as lf, coalesce(max(density) over (partition by symbol order by bin range between 1 following and 1 following), 0) as rt from profile) _p where bin between 1 and 98 and density > lf and density > rt and density > 0.015e0),
profit as (select symbol, round(coalesce(sum(case when centre <= last_close then cast(density*1e12 as bigint) end), 0)/1e10, 2) as profit_ratio from profile group by symbol),
cut as (select symbol, max(last_close) as c, min(case when cum >= 150000000000 then centre end) as l70, min(case when cum >= 850000000000 then centre end) as h70, min(case when cum >= 50000000000 then centre end) as l90, min(case when cum >= 950000000000 then centre end) as h90
        from (select *, sum(cast(density*1e12 as bigint)) over (partition by symbol order by bin rows unbounded preceding) as cum from profile) _c group by symbol),
conc as (select symbol, round((h70 - l70)/(c + 1e-9)*100, 2) as conc_70, round((h90 - l90)/(c + 1e-9)*100, 2) as conc_90, round(l70, 2) as low_70, round(h70, 2) as high_70, round(l90, 2) as low_90, round(h90, 2) as high_90, round((h90 - l90)/(c + 1e-9)*100, 2) < 10 as single_peak from cut)""")

for _n, _f, _t in (("v3_poc", prof.profile_poc, "poc"), ("v4_peaks", prof.profile_peaks, "peaks"), ("v5_profit_ratio", prof.profit_ratio, "profit"), ("v6_concentration", prof.concentration, "conc")):
    query(_n, f"{B}, {PROFILE}, {SUMMARY} select * from {_t}", "centre density" if _t == "peaks" else "")(lambda spark, d, f=_f: f(profile(spark, d)))

MA = f"select symbol, date, close, {SMA} from bars"
LAST = "qualify row_number() over (partition by symbol order by date desc) = 1"


def _items(weights: dict[str, int], prefix: str, category: str, table: str) -> str:
    return " union all ".join(f"select symbol, {c} as price, {w} as weight, '{prefix}_{c}' as source, '{category}' as category from {table}" for c, w in weights.items())


R_CENTRE = portable("round(centre, 2)")
BAND = portable("round(sum(price*weight)/(sum(weight) + 1e-9), 2) as centre, round(min(price), 2) as low, round(max(price), 2) as high")


def candidates_cte(hours: str | None = None) -> str:
    """hours: text of hourly bars, whose last row then gives candidates too."""
    weekly = f"wb as materialized (select symbol, week as date, open, high, low, close, volume, amount from {WEEKLY} _w)"
    row = lambda t: f"(select m.*, boll_upper, boll_lower from ({MA}) m join (select symbol, date, boll_upper, boll_lower from {BOLL} _b) b using (symbol, date) {LAST})".replace("from bars", f"from {t}")
    hourly = f"hb as materialized ({hours}), lh as materialized (select * from {row('hb')} _h), " if hours else ""
    of_hours = " union all " + _items(lev.HOURLY_WEIGHTS, "hour", "INTRADAY_60M", "lh") if hours else ""
    return f"""{hourly}{weekly}, ld as materialized (select * from {row('bars')} _d), lw as materialized (select * from {row('wb')} _w),
cand as materialized (select * from ({_items(lev.DAILY_WEIGHTS, 'day', 'MA_CHANNEL', 'ld')} union all {_items(lev.WEEKLY_WEIGHTS, 'week', 'WEEKLY_MA', 'lw')}{of_hours}
  union all select symbol, poc, 35, 'poc', 'CHIPS' from poc union all select symbol, low_70, 18, 'range_low', 'CHIPS' from conc union all select symbol, high_70, 18, 'range_high', 'CHIPS' from conc
  union all select symbol, {R_CENTRE}, 20, 'peak_' || cast(cast({R_CENTRE} as decimal(12,2)) as varchar), 'CHIPS' from peaks join poc using (symbol) where abs({R_CENTRE} - poc)/poc > 0.03e0
  union all select symbol, price, 24, 'swing_' || kind || '_' || date, 'STRUCTURE' from swings
  union all select symbol, case when kind = 'UP_GAP' then bottom else top end, 26, kind || '_' || date, 'GAP' from gaps
  union all select symbol, price, 22, 'fib_' || ratio, 'FIBONACCI' from fib where ratio in (0.382e0, 0.5e0, 0.618e0)) _c where price > 0),
sided as materialized (select c.*, close, case when price <= close*0.9995e0 then 'support' else 'resistance' end as side from cand c join (select symbol, close from ld) l using (symbol) where price <= close*0.9995e0 or price >= close*1.0005e0),
so as materialized (select *, row_number() over (partition by symbol, side order by price, source, weight, category) as i from sided),
cl(symbol, side, i, price, source, weight, category, close, cluster, first, total, n) as (
  select symbol, side, i, price, source, weight, category, close, 0, price, price, 1 from so where i = 1
  union all select symbol, side, i, price, source, weight, category, close, case when j then cluster else cluster + 1 end, case when j then first else price end, case when j then total + price else 0e0 + price end, case when j then n + 1 else 1 end
  from (select so.*, cluster, first, total, n, abs(so.price - total/n) <= total/n*0.015e0 and abs(so.price - first) <= first*0.015e0*2 as j from cl join so on so.symbol = cl.symbol and so.side = cl.side and so.i = cl.i + 1) _j),
bands as (select symbol, side, cluster, {BAND}, (sum(weight) + (count(distinct category) - 1)*15)::int as score,
    array_to_string(list(source order by price, source), ',') as sources, count(*) as items from cl group by symbol, side, cluster),
starred as (select *, case when score >= 75 then 5 when score >= 55 then 4 when score >= 38 then 3 when score >= 22 then 2 else 1 end as stars from bands),
ranked as materialized (select * exclude (cluster), case when side = 'support' then 'S' else 'R' end || nth as label from (select *, row_number() over (partition by symbol, side order by case when side = 'support' then -centre else centre end) as nth from starred) _n where nth <= 5)"""


LEVELS = f"{BR}, {PROFILE}, {SUMMARY}, {SWINGS}, {GAPS}, {WAVES}, {candidates_cte()}"


def day_frame(bars):
    """Bars with every indicator that a state row takes."""
    return _day_rest(ind.recursions(bars))


def _day_rest(walked):
    frame = ind.vol_ratio(ind.atr(ind.bollinger(ind.sma(walked))))
    return st.volume_features(norm.change_pct(frame))


def recent_frame(bars):
    """The last bars of each symbol with what day_frame() gives the newest one, and n, its number of bars. Only the recursions
    read whole series: the longest mean looks back 250 bars, so older ones go before the next exchange and sort."""
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    walked = ind.recursions(bars.withColumns({"n": size, "_left": size - position()}))
    return _day_rest(walked.where(F.col("_left") <= max(ind.SPANS)).drop("_left"))


def day_state(bars):
    """last_state() of day_frame(), in one pass over each series that leaves the bars that divergences look at."""
    return st.last_state(st.day_features(bars, st.PIVOT_ROWS).drop("_i").withColumnRenamed("_n", "n"))


def week_state(bars):
    """The newest week of each symbol with its means and bands, in one pass over its weeks."""
    weeks = norm.weekly(bars)
    made = [f"ma_{n}" for n in ind.SPANS] + ["boll_mid", "boll_upper", "boll_lower", "boll_width"]
    return ind.day_indicators(weeks, 1).select(*weeks.columns, *made)


def profile_state(bars):
    return prof.newest_profile_state(bars)


def part(name, spark, d, bars=None):
    """A table of one row a symbol (day, week or profile): the levels and the state rows of all queries stand on the same three."""
    make = {"day": day_state, "week": week_state, "profile": profile_state}[name]
    return make(bars) if bars is not None else cb.kept(f"{name}-state", spark, d, lambda: make(daily(spark, d)))


def half_hourly(spark, d):
    return cb.kept("half-hourly", spark, d, lambda: fixtures.half_hourly(spark, d).withColumnRenamed("ts", "date"))


def candidates(spark, d, bars=None, hours=None):
    """Candidates of the folder's bars, or of other bars, with those of hourly bars if these are given."""
    day, week, profiled = (part(name, spark, d, bars) for name in ("day", "week", "profile"))
    marks = cb.kept("level-marks", spark, d, lambda: st.level_marks(daily(spark, d))) if bars is None else st.level_marks(bars)
    hour = None if hours is None else ind.bollinger(ind.sma(hours, (20, 60, 120)))
    return lev.level_candidates(day, week, hour, profiled, None, st.marked_swings(marks), st.marked_gaps(marks), st.marked_waves(marks), single=True)


def closes(bars):
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))


@query("l1_candidates", f"{LEVELS} select * from cand", "price")
def _(spark, d):
    return candidates(spark, d)


@query("l2_sides", f"{LEVELS} select * from sided", "price")
def _(spark, d):
    return lev.split_sides(candidates(spark, d), closes(daily(spark, d)))


def clustered(spark, d):
    return lev.cluster_levels(lev.split_sides(candidates(spark, d), closes(daily(spark, d))))


@query("l3_clusters", f"{LEVELS} select symbol, side, cluster, price, source, weight, category, close from cl", "price")
def _(spark, d):
    return clustered(spark, d)


@query("l4_bands", f"{LEVELS} select * from starred")
def _(spark, d):
    return lev.score_bands(clustered(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query("l5_ranked", f"{LEVELS} select * from ranked")
def _(spark, d):
    return lev.levels(candidates(spark, d), closes(daily(spark, d))).withColumn("sources", F.array_join("sources", ","))


HOURS = f"select symbol, ts as date, open, high, low, close, volume, volume as amount from ({HOURLY}) h"
INTRADAY = f"{BR.replace(DAILY, EVENT_DAILY)}, {PROFILE}, {SUMMARY}, {SWINGS}, {GAPS}, {WAVES}, {candidates_cte(HOURS)}"


def intraday(spark, d):
    """Days and candidates of the event series; days and hours are rolled up from one table of half-hours."""
    half = half_hourly(spark, d)
    days = norm.roll_up(half, "day")
    return days, candidates(spark, d, days, norm.roll_up(half, "hour"))


@query("l1_intraday", f"{INTRADAY} select * from cand", "price")
def _(spark, d):
    return intraday(spark, d)[1]


@query("l5_intraday", f"{INTRADAY} select * from ranked")
def _(spark, d):
    days, found = intraday(spark, d)
    return lev.levels(found, closes(days)).withColumn("sources", F.array_join("sources", ","))


QUERIES = {k: v for k, v in cb.QUERIES.items() if k not in _LOCAL}
ORACLE = {k: cb.ORACLE[k] for k in QUERIES if k in cb.ORACLE}
