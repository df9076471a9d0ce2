"""Queries over regime, probability and evaluation operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions import stats
from candela.functions.windows import position
from candela.operators import evaluation as ev
from candela.operators import exits as ex
from candela.operators import indicators as ind
from candela.operators import regime as rg
from candela.plans import catalog_bars as cb
from candela.plans.catalog_bars import ATR, B, BOLL, BR, CHANGE, SMA, VR, daily, full_sql, mean_sql, portable, query, recursion_cte, rsi_sql, run_sql, tagged, win
from candela.plans.fixtures import DAILY, FUNDING, INDEX_DAILY, derive, index_daily
from candela.sources import bars as src

_LOCAL = set(cb.QUERIES)


def index(spark, d):
    return cb.kept("index", spark, d, lambda: index_daily(spark, d))


def first_index(spark, d):
    """Dates and closes of index 0: a row a date."""
    return cb.kept("index-0", spark, d, lambda: index_daily(spark, d, 0).select("date", "close"))


def regime(spark, d):
    return cb.kept("regime", spark, d, lambda: rg.features(index(spark, d), derive(spark, d, FUNDING)))


_L = "lag(close, {0}) over (partition by symbol order by date)"
R1 = f"(select *, {mean_sql('close', 200)} as ma200, (close/{_L.format(20)} - 1)*100 as ret20, (close/{_L.format(60)} - 1)*100 as ret60, (close/({mean_sql('close', 20)}) - 1)*100 as dev_ma20, (close/({full_sql('min(low) ' + win(60), 'low', 60)}) - 1)*100 as dist_low60, volume/({full_sql('avg(volume) ' + win(20), 'volume', 20)}) as vol_ratio20, {_L.format(1)} as before from bars)"
R2 = portable(f"(select r.*, balance, lag(f5) over (partition by symbol order by r.date) as funding_5d from {R1} r left join (select date, balance, round((balance/lag(balance, 5) over (order by date) - 1)*100, 2) as f5 from ({FUNDING}) _f) f on f.date = r.date)")
_RAW = {"ice_ret20": "-ret20", "ice_dev": "-dev_ma20", "ice_ret60": "-ret60", "ice_vol": "case when vol_ratio20 > 0 then 1/vol_ratio20 end", "ice_margin": "-funding_5d", "ice_consec": "cast(down_run as double)"}


def _rank(k: str) -> str:
    values = f"(list({k}_x) filter ({k}_x is not null) {win(250)})"
    return f"case when len({values}) >= 120 and {k}_x is not null then len(list_filter({values}, lambda v: v < {k}_x))::double/len({values}) end as {k}"


ICE = f"""reg as materialized (select * from {run_sql('close < before', 'down_run', R2)} _r),
raws as (select *, {', '.join(f'{v} as {k}_x' for k, v in _RAW.items())} from reg),
ranks as materialized (select *, {', '.join(_rank(k) for k in _RAW)} from raws),
ice as materialized (select *, case when {' + '.join(f'case when {k} is not null then {w}e0 else 0e0 end' for k, w in rg.ICE_WEIGHTS.items())} > 0 then """ + portable(f"""round((0e0 + {' + '.join(f'coalesce({k}*{w}e0, 0e0)' for k, w in rg.ICE_WEIGHTS.items())})/(0e0 + {' + '.join(f'case when {k} is not null then {w}e0 else 0e0 end' for k, w in rg.ICE_WEIGHTS.items())})*100, 1)""") + """ else 0e0 end as ice_score from ranks)"""
VOL = f"""
lr as materialized (select *, ln(close/{_L.format(1)}) as ret, pow(ln(high/low), 2) as rng, row_number() over (partition by symbol order by date) as i from bars),
ew(symbol, date, i, v) as (select symbol, date, i, null::double from lr where i = 1 union all select lr.symbol, lr.date, lr.i, coalesce(0.94e0*v + (1 - 0.94e0)*(ret*ret), ret*ret) from ew join lr on lr.symbol = ew.symbol and lr.i = ew.i + 1),
vb as (select *, 0.4e0*({full_sql('avg(rng) ' + win(20), 'rng', 20)}/(4*ln(2))) + 0.3e0*v + 0.3e0*pow({full_sql('stddev_samp(ret) ' + win(250), 'ret', 250)}, 2) as var from lr join ew using (symbol, date)),
vol as materialized (select symbol, date, sqrt(case when var > 0 then var end)*100 as sigma_pct, sqrt(case when var > 0 then var end)*100*sqrt(10) as sigma10_pct from vb)"""


def _tail_sql(x: str) -> str:
    h = lambda c: "".join("(" * (len(c) - 1)) + repr(c[0]) + "e0" * ("e" not in repr(c[0])) + "".join(f"*abs({x}) + {repr(v)}{'e0' * ('e' not in repr(v))})" for v in c[1:])
    a = f"abs({x})"
    near = f"exp(-{a}*{a}/2)*{h(stats.HART_TOP)}/{h(stats.HART_BOTTOM)}"
    far = f"exp(-{a}*{a}/2)/({a} + 1/({a} + 2/({a} + 3/({a} + 4/({a} + 0.65e0)))))/2.506628274631e0"
    t = f"case when {a} > 37 then 0e0 when {a} < 7.07106781186547e0 then {near} else {far} end"
    return f"(case when {x} >= 0 then {t} else 1 - {t} end)"


LABELS = """
lab as materialized (select *, (lead(close, 10) over w/close - 1)*100 as fwd10, (lead(close, 10) over w/lead(open) over w - 1)*100 as trade_ret, cast((lead(close, 10) over w/close - 1)*100 >= 2.5e0 as int) as rebound from bars window w as (partition by symbol order by date))"""
X = f"with recursive bars as materialized ({INDEX_DAILY})"
FULL = f"""{X}, {ICE}, {VOL}, {LABELS},
al as materialized (select ice.symbol, ice.date, ice.close, ma200, ice_score, {', '.join(rg.ICE_WEIGHTS)}, sigma10_pct, fwd10, trade_ret, rebound, case when sigma10_pct > 0 then {_tail_sql('(2.5e0/sigma10_pct)')} end as p,
    row_number() over (partition by ice.symbol order by ice.date) - 1 as pos from ice join vol using (symbol, date) join lab using (symbol, date)),
labelled as (select *, case when ice_score < 20 then 0 when ice_score < 40 then 1 when ice_score < 60 then 2 when ice_score < 80 then 3 else 4 end as bin from al where rebound is not null)"""


def wilson_sql(hits: str, n: str) -> tuple[str, str]:
    p = f"(({hits})/nullif(cast({n} as double), 0))"
    mid, wide, scale = f"({p} + 3.8416e0/(2*cast({n} as double)))", f"(1.96e0*sqrt({p}*(1 - {p})/cast({n} as double) + 3.8416e0/(4*cast({n} as double)*cast({n} as double))))", f"(1 + 3.8416e0/cast({n} as double))"
    return f"case when {n} = 0 then 0e0 else greatest(0e0, ({mid} - {wide})/{scale}) end", f"case when {n} = 0 then 1e0 else least(1e0, ({mid} + {wide})/{scale}) end"


def rate_sql(x: str, p: str) -> str:
    low, high = wilson_sql(f"count_if({x} > 0)", f"count({x})")
    return f"count({x}) as {p}_n, 100e0*count_if({x} > 0)/nullif(count({x}), 0) as {p}_hit, case when count({x}) > 0 then 100*({low}) end as {p}_low, case when count({x}) > 0 then 100*({high}) end as {p}_high, avg({x}) as {p}_mean, median({x}) as {p}_median, case when sum(case when {x} < 0 then -{x} end) > 0 then coalesce(sum(case when {x} > 0 then {x} end), 0)/sum(case when {x} < 0 then -{x} end) end as {p}_pf"


def rate_columns(p: str) -> str:
    return " ".join(f"{p}_{c}" for c in ("hit", "low", "high", "mean", "median", "pf"))


@query("r1_regime", f"with bars as ({INDEX_DAILY}) select symbol, date, ma200, ret20, ret60, dev_ma20, dist_low60, vol_ratio20 from {R1} _r", "ma200 ret20 ret60 dev_ma20 dist_low60 vol_ratio20")
def _(spark, d):
    return rg.regime_features(index(spark, d)).select("symbol", "date", "ma200", "ret20", "ret60", "dev_ma20", "dist_low60", "vol_ratio20")


@query("r2_funding", f"with bars as ({INDEX_DAILY}) select symbol, date, balance, funding_5d from {R2} _r")
def _(spark, d):
    return rg.funding_join(index(spark, d), derive(spark, d, FUNDING)).select("symbol", "date", "balance", "funding_5d")


@query("r3_ranks", f"{X}, {ICE} select symbol, date, {', '.join(rg.ICE_WEIGHTS)} from ranks", " ".join(rg.ICE_WEIGHTS))
def _(spark, d):
    return regime(spark, d).select("symbol", "date", *rg.ICE_WEIGHTS)


@query("r4_ice_score", f"{X}, {ICE} select symbol, date, ice_score from ice")
def _(spark, d):
    return regime(spark, d).select("symbol", "date", "ice_score")


@query("p1_volatility", f"{X}, {VOL} select * from vol", "sigma_pct sigma10_pct")
def _(spark, d):
    return rg.blended_volatility(index(spark, d)).select("symbol", "date", "sigma_pct", "sigma10_pct")


@query("p2_exceedance", f"{FULL} select symbol, date, p from al", "p")
def _(spark, d):
    return regime(spark, d).select("symbol", "date", "p")


@query("p3_labels", f"{X}, {LABELS} select symbol, date, fwd10, trade_ret, rebound from lab", "fwd10 trade_ret")
def _(spark, d):
    return rg.forward_labels(index(spark, d)).select("symbol", "date", "fwd10", "trade_ret", "rebound")


@query("p4_bands", f"{X}, {VOL} select symbol, date, -sigma10_pct as low_68, sigma10_pct as high_68, -1.645e0*sigma10_pct as low_90, 1.645e0*sigma10_pct as high_90 from vol", "low_68 high_68 low_90 high_90")
def _(spark, d):
    return rg.volatility_bands(regime(spark, d)).select("symbol", "date", "low_68", "high_68", "low_90", "high_90")


@query("p5_coverage", f"{FULL} select symbol, count(*) as n, 100*avg(case when abs(fwd10) <= sigma10_pct then 1e0 else 0e0 end) as coverage_68, 100*avg(case when abs(fwd10) <= 1.645e0*sigma10_pct then 1e0 else 0e0 end) as coverage_90 from al where sigma10_pct is not null and fwd10 is not null group by symbol", "coverage_68 coverage_90")
def _(spark, d):
    return rg.band_coverage(regime(spark, d))


@query("p6_score_bins", f"{FULL} select symbol, date, ice_score, bin from labelled")
def _(spark, d):
    return rg.labelled(regime(spark, d)).select("symbol", "date", "ice_score", "bin")


@query("p7_shrunk_bins", f"{FULL}, b as (select symbol, (sum(rebound) + 1)/(count(*) + 2e0) as base from labelled group by symbol) select symbol, bin, count(*) as n, sum(rebound)::bigint as hits, max(base) as base, (sum(rebound) + 20*max(base))/(count(*) + 20) as probability from labelled join b using (symbol) group by symbol, bin", "base probability")
def _(spark, d):
    return rg.shrunk_bins(rg.labelled(regime(spark, d)))


_W, _WE = wilson_sql("hits", "n"), wilson_sql("hits/n::double*n_eff", "n_eff")


@query("p8_bin_report", f"{FULL}, g as (select symbol, bin, count(*) as n, sum(rebound)::bigint as hits, avg(fwd10) as mean_fwd, avg(trade_ret) as mean_trade, count(*)//10 as n_eff from labelled group by symbol, bin) select *, 100e0*hits/n as hit_pct, 100*({_W[0]}) as low, 100*({_W[1]}) as high, 100*({_WE[0]}) as low_eff, 100*({_WE[1]}) as high_eff, n >= 30 as usable from g", "mean_fwd mean_trade hit_pct low high low_eff high_eff")
def _(spark, d):
    return rg.bin_report(rg.labelled(regime(spark, d)))


@query("p9_regime_split", f"{FULL} select symbol, close > ma200 as above, count(*) as n, 100*avg(rebound) as hit_pct, count_if(ice_score >= 60) as cold_n, case when count_if(ice_score >= 60) >= 8 then 100*avg(case when ice_score >= 60 then rebound end) end as cold_hit_pct from labelled where ma200 is not null group by all", "hit_pct cold_hit_pct")
def _(spark, d):
    return rg.regime_split(rg.labelled(regime(spark, d)))


WF = """wf as materialized (select symbol, pos, p, rebound, (h + 1)/(n + 2e0) as baseline from (select *, count(rebound) over w as n, coalesce(sum(rebound) over w, 0) as h from al where rebound is not null and p is not null
  window w as (partition by symbol order by pos range between unbounded preceding and 11 preceding)) _w where n >= 120)"""


def walked(spark, d):
    return rg.walk_forward(regime(spark, d).withColumn("pos", position()).select("symbol", "date", "pos", "p", "rebound"))


@query("p11_walk_forward", f"""{FULL}, {WF}, r as (select *, pow(p - rebound, 2) as m, pow(baseline - rebound, 2) as b, -(rebound*ln(p) + (1 - rebound)*ln(1 - p)) as l, pos % 11 as part from wf),
q as (select symbol, part, sum(m) as m, sum(b) as b, sum(l) as l, count(*) as n from r group by symbol, part)
select symbol, sum(n)::bigint as n, sum(n)::bigint//11 as n_eff, sum(m)/sum(n) as brier, sum(b)/sum(n) as brier_base, 1 - sum(m)/sum(b) as skill, sum(l)/sum(n) as log_loss, count_if(m < b) as positive_parts from q group by symbol""", "brier brier_base skill log_loss")
def _(spark, d):
    return rg.walk_forward_report(walked(spark, d))


BINNED = """wb0 as (select *, count(rebound) over s as train_n, coalesce(sum(rebound) over s, 0) as h, count(rebound) over b as bin_n, coalesce(sum(rebound) over b, 0) as bh from labelled
  window s as (partition by symbol order by pos range between unbounded preceding and 11 preceding), b as (partition by symbol, bin order by pos range between unbounded preceding and 11 preceding)),
wb1 as materialized (select *, (h + 1)/(train_n + 2e0) as baseline, (bh + 20*((h + 1)/(train_n + 2e0)))/(bin_n + 20) as p_bin from wb0 where train_n >= 120),
wb2 as (select symbol, unnest(list_reduce(list([pos] order by pos), lambda a, x: case when x[1] - a[-1] > 10 then list_concat(a, x) else a end)) as pos from wb1 group by symbol),
wbin as materialized (select symbol, pos, p_bin as p, baseline, rebound, train_n, bin_n from wb1 join wb2 using (symbol, pos))"""


def binned(spark, d):
    rows = rg.labelled(regime(spark, d).withColumn("pos", position()))
    return rg.walk_forward_binned(rows.select("symbol", "pos", "bin", "rebound"))


@query("p12_walk_forward_binned", f"{FULL}, {BINNED} select * from wbin", "p baseline")
def _(spark, d):
    return binned(spark, d)


@query("p12_binned_report", f"""{FULL}, {BINNED}, g as (select symbol, count(*) as n, avg(pow(p - rebound, 2)) as brier, avg(pow(baseline - rebound, 2)) as brier_base, avg(-(rebound*ln(p) + (1 - rebound)*ln(1 - p))) as log_loss, avg(-(rebound*ln(baseline) + (1 - rebound)*ln(1 - baseline))) as log_loss_base from wbin group by symbol)
select *, 1 - brier/brier_base as skill, case when n < 60 then 'insufficient_oos' when 1 - brier/brier_base > 0 then 'positive_oos_skill' else 'no_oos_edge' end as status from g""", "brier brier_base log_loss log_loss_base skill")
def _(spark, d):
    return rg.binned_report(binned(spark, d))


_WR = wilson_sql("realised*n_eff", "n_eff")
REL = f"rel as (select *, {_WR[0]} as low, {_WR[1]} as high from (select symbol, case when p < 0.15e0 then 0 when p < 0.25e0 then 1 when p < 0.35e0 then 2 when p < 0.45e0 then 3 else 4 end as bucket, count(*) as n, avg(p) as predicted, avg(rebound) as realised, count(*)//11 as n_eff from wf group by all) _g)"


@query("p14_reliability", f"{FULL}, {WF}, {REL} select * from rel", "predicted realised low high")
def _(spark, d):
    return rg.reliability_table(walked(spark, d))


@query("p15_interval", f"{FULL}, {WF}, {REL}, t as (select symbol, date, p, case when p < 0.15e0 then 0 when p < 0.25e0 then 1 when p < 0.35e0 then 2 when p < 0.45e0 then 3 else 4 end as bucket from al qualify row_number() over (partition by symbol order by date desc) = 1) select t.*, n, realised, low, high from t left join rel using (symbol, bucket)", "p realised low high")
def _(spark, d):
    return rg.reliability_interval(src.latest(regime(spark, d).select("symbol", "date", "p")), rg.reliability_table(walked(spark, d)))


_WN = wilson_sql("hits", "n")


@query("p16_wilson", f"{B}, g as (select symbol, count(*) as n, count_if(close > open) as hits from bars group by symbol) select *, {_WN[0]} as low, {_WN[1]} as high from g", "low high")
def _(spark, d):
    g = daily(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("close") > F.col("open")).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"low": low, "high": high})


#: The fit at k is the largest over starts up to k of the smallest, over ends from k on, of the weighted means between.
ISOTONIC = f"""{FULL}, b as (select symbol, (sum(rebound) + 1)/(count(*) + 2e0) as base from labelled group by symbol),
pt as (select symbol, bin, (sum(rebound) + 20*max(base))/(count(*) + 20) as value, count(*)::double as weight from labelled join b using (symbol) group by symbol, bin),
iv as (select i.symbol, i.bin as i, j.bin as j, sum(m.value*m.weight)/sum(m.weight) as v from pt i join pt j on i.symbol = j.symbol and i.bin <= j.bin join pt m on m.symbol = i.symbol and m.bin between i.bin and j.bin group by all),
lo as (select k.symbol, k.bin, i, min(v) as v from pt k join iv on iv.symbol = k.symbol and iv.i <= k.bin and iv.j >= k.bin group by all)
select pt.*, fitted from pt join (select symbol, bin, max(v) as fitted from lo group by symbol, bin) f using (symbol, bin)"""


@query("p10_isotonic", ISOTONIC, "value fitted")
def _(spark, d):
    bins = rg.shrunk_bins(rg.labelled(regime(spark, d)))
    return rg.isotonic_curves(bins.select("symbol", "bin", F.col("probability").alias("value"), F.col("n").cast("double").alias("weight")))


BOOTSTRAP = f"""{FULL}, {WF}, gn as (select symbol, row_number() over (partition by symbol order by pos) - 1 as pos, pow(baseline - rebound, 2) - pow(p - rebound, 2) as gain from wf),
bk as (select symbol, pos, sum(gain) over (partition by symbol order by pos rows between current row and 10 following) as total, count(*) over (partition by symbol) as n from gn),
dr as (select symbol, i, b, ('0x' || substr(md5(i || ':' || b), 1, 15))::bigint % (n - 10) as pos from (select symbol, max(n) as n from bk group by symbol) _s, range(4000) _i(i), range(1, 100000) _b(b) where n >= 55 and b <= n//11),
tt as (select symbol, i, sum(total) as total from dr join bk using (symbol, pos) group by symbol, i)
select symbol, avg(case when total <= 0 then 1e0 else 0e0 end) as p_value from (select distinct symbol from gn) _g left join tt using (symbol) group by symbol"""


@query("p13_bootstrap", BOOTSTRAP, "p_value")
def _(spark, d):
    from pyspark.sql import Window

    gains = walked(spark, d).withColumn("gain", F.pow(F.col("baseline") - F.col("rebound"), 2) - F.pow(F.col("p") - F.col("rebound"), 2))
    gains = gains.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("pos")) - 1)
    return rg.block_bootstrap(gains.select("symbol", "pos", "gain"))


MISSING = f"array_to_string(list_filter([{', '.join(f"case when {k} is null then '{k}' end" for k in rg.ICE_WEIGHTS)}], lambda x: x is not null), ',')"


@query("p17_latest", f"{FULL}, {WF} select symbol, date, ice_score, p, p as p_drop, p/b.base as lift, {MISSING} as missing, 'valid' as status from (select * from al qualify row_number() over (partition by symbol order by date desc) = 1) l join (select symbol, avg(baseline) as base from wf group by symbol) b using (symbol)", "p p_drop lift")
def _(spark, d):
    asof = regime(spark, d).groupBy("symbol").agg(F.max("date").alias("asof"))
    base = walked(spark, d).groupBy("symbol").agg(F.avg("baseline").alias("base")).join(asof, "symbol")
    return rg.predict_latest(regime(spark, d), base).withColumn("missing", F.array_join("missing", ","))


GRID = "(select * exclude (_n) from (select *, row_number() over (partition by symbol order by date) - 1 as t, count(*) over (partition by symbol) as _n from {0} _g0) _g1 where _n >= 272 and t between 249 and _n - 22 and (t - 249) % 3 = 0)"


@query("e1_grid", f"{B} select symbol, date, t from {GRID.format('bars')} _g")
def _(spark, d):
    return ev.asof_grid(daily(spark, d)).select("symbol", "date", "t")


FILL = "(select *, coalesce(entry > 0 and (entry - close)/close*100 < 1.5e0 - 0.5e0, false) as fillable from (select *, lead(open) over (partition by symbol order by date) as entry from {0} _f0) _f1)"


@query("e3_fill", f"{B} select symbol, date, entry, fillable from {FILL.format('bars')} _f")
def _(spark, d):
    return ev.entry_fill(daily(spark, d), 1.5).select("symbol", "date", "entry", "fillable")


def _ret(h: int) -> str:
    return portable(f"case when fillable then round((lead(close, {h + 1}) over w - entry)/entry*100 - 1, 2) end as ret_{h}")


RETURNS = f"(select *, {', '.join(map(_ret, ev.HORIZONS))}, lead(date) over w as _from, {', '.join(f'lead(date, {h + 1}) over w as _to_{h}' for h in ev.HORIZONS)} from {FILL} _r0 window w as (partition by symbol order by date))"
EXCESS = f"""{B}, ix as (select date, close from ({INDEX_DAILY}) i where symbol = 0), r as (select * from {RETURNS.format('bars')} _r)
select r.symbol, r.date, ret_5, ret_10, ret_20, """ + ", ".join(portable(f"round(ret_{h} + 1 - (i{h}.close/i0.close - 1)*100, 2) as excess_{h}") for h in ev.HORIZONS) + " from r left join ix i0 on i0.date = _from " + " ".join(f"left join ix i{h} on i{h}.date = _to_{h}" for h in ev.HORIZONS)


@query("e4_returns", EXCESS)
def _(spark, d):
    return ev.horizon_returns(ev.entry_fill(cb.daily_once(spark, d), 1.5), first_index(spark, d)).select("symbol", "date", *(f"{k}_{h}" for k in ("ret", "excess") for h in ev.HORIZONS))


def _sweep_sql(variants: str, horizons: str) -> str:
    """Exits of each entry and variant, one day of all of them at a time."""
    return f"""
nb as materialized (select symbol, open, high, low, close, row_number() over (partition by symbol order by date) - 1 as i from bars),
en as materialized (select g.symbol, g.t, g.date, g.entry, variant, stop, h from (select f.*, atr from {GRID.format(FILL.format('bars'))} f join (select symbol, date, atr from {ATR} _a) a using (symbol, date) where fillable) g, {variants}, {horizons}),
wk(symbol, t, variant, h, k, stop, s, due, before, price, hit) as (
  select symbol, t, variant, h, 0, stop, false, false, null::double, null::double, null::boolean from en
  union all
  select symbol, t, variant, h, k + 1, stop, s or (touched and not due), due or isdue, c,
    case when trades and (s or due) then o when trades and touched then least(o, stop) when trades and isdue then c end, case when trades and (s or due) then s when trades and touched then true when trades and isdue then false end
  from (select wk.*, nb.open as o, nb.close as c, nb.low <= stop as touched, k >= h as isdue,
          k > 0 and not (nb.close <= before*(1 - 1.5e0/100 + 0.001e0) and abs(nb.low - nb.close) <= 1e-8 and abs(nb.high - nb.low) <= 1e-8 and abs(nb.open - nb.low) <= 1e-8) as trades
        from wk join nb on nb.symbol = wk.symbol and nb.i = wk.t + 1 + k where price is null) _x),
sold as materialized (select en.symbol, en.t, en.date, en.variant, en.h as horizon, {portable('round((wk.price - en.entry)/en.entry*100 - 1, 2)')} as ret, wk.hit from en left join (select * from wk where price is not null) wk on wk.symbol = en.symbol and wk.t = en.t and wk.variant = en.variant and wk.h = en.h)"""


ONE = "(select 'atr_3' as variant) v0, lateral (select g.entry - 3*atr as stop) v"
ALL = "(select unnest([" + ", ".join([f"'atr_{m:g}'" for m in ex.ATR_STOPS] + [f"'fixed_{p:g}'" for p in ex.FIXED_STOPS]) + "]) as variant, unnest([" + ", ".join([f"{m}e0" for m in ex.ATR_STOPS] + ["null"] * len(ex.FIXED_STOPS)) + "]) as m, unnest([" + ", ".join(["null"] * len(ex.ATR_STOPS) + [f"{p}e0" for p in ex.FIXED_STOPS]) + "]) as f) v0, lateral (select case when m is not null then g.entry - m*atr else g.entry*(1 - f/100) end as stop) v"
BX = f"with recursive bars as materialized ({DAILY})"


def entries(spark, d):
    frame = ex.forward_days(ind.atr(ev.horizon_returns(ev.entry_fill(daily(spark, d), 1.5))), 1.5)
    return ev.asof_grid(frame).where("fillable").select("symbol", "t", "date", "close", "entry", "atr", "days", "ret_10", "ret_20")


@query("e5_exit", f"{BX}, {_sweep_sql(ONE, '(select 10 as h) hh')} select symbol, t, ret, hit from sold")
def _(spark, d):
    rows = entries(spark, d)
    rows = rows.withColumn("x", ex.exit_within(F.col("days"), F.col("entry") - 3 * F.col("atr"), 10))
    from candela.functions.windows import rounded

    return rows.select("symbol", "t", rounded((F.col("x.price") - F.col("entry")) / F.col("entry") * 100 - 1, 2).alias("ret"), F.col("x.hit").alias("hit"))


SWEEP = f"{BX}, {_sweep_sql(ALL, '(select unnest([10, 20]) as h) hh')}"


def sweep(spark, d):
    return cb.kept("sweep", spark, d, lambda: ex.stop_sweep(entries(spark, d)))


@query("e6_sweep", f"{SWEEP} select * from sold")
def _(spark, d):
    return sweep(spark, d)


_FILLED = f"{GRID.format(RETURNS.format('bars'))} f"
NO_STOP = f"""al as (select variant, horizon, ret, hit from sold union all select 'none', h, ret, false from (select unnest([10, 20]) as h, unnest([ret_10, ret_20]) as ret from {_FILLED} where fillable) _u),
ap as (select median(x) as atr_pct from (select {portable('round(atr/close*100, 2)')} as x from {_FILLED} join (select symbol, date, atr from {ATR} _a) a using (symbol, date) where fillable and atr > 0) _m),
rp as (select variant, horizon, {rate_sql('ret', 'ret')}, case when variant <> 'none' then count(*) - count(ret) end as censored, 100*avg(case when ret is not null then case when hit then 1e0 else 0e0 end end) as stop_hit, quantile_cont(ret, 0.05) as q05, stddev_samp(ret) as std from al group by variant, horizon)"""


@query(
    "e16_sweep_report",
    f"{SWEEP}, {NO_STOP} select rp.*, ret_mean - max(case when variant = 'none' then ret_mean end) over (partition by horizon) as vs_none, atr_pct from rp, ap",
    rate_columns("ret") + " stop_hit q05 std vs_none atr_pct",
)
def _(spark, d):
    return ev.sweep_report(sweep(spark, d), entries(spark, d))


CONDITIONS = f"""{BR}, fr as materialized (select c.*, ma_20, ma_60, ma_120, boll_lower, vol_ratio, kdj_j, hist, rsi_6, lag(hist) over (partition by symbol order by c.date) as hist_before from (select * from {CHANGE} _c) c join (select symbol, date, {SMA} from bars) m using (symbol, date)
  join (select symbol, date, boll_lower from {BOLL} _b) b using (symbol, date) join (select symbol, date, vol_ratio from {VR} _v) v using (symbol, date) join rec using (symbol, date) join (select symbol, date, {rsi_sql(6)} as rsi_6 from {cb._DELTA} _d) r using (symbol, date)),
fl as materialized (select *, coalesce(close > ma_20 and ma_20 > ma_60, false) as ma_bull, coalesce(close > ma_20 and ma_20 > ma_60 and ma_60 > ma_120, false) as ma_bull_full, coalesce(close < ma_20 and ma_20 < ma_60, false) as ma_bear, coalesce(close >= 0.975e0*ma_20 and close <= 1.03e0*ma_20, false) as near_ma20,
  coalesce(kdj_j < 45, false) as j_lt45, coalesce(kdj_j < 20, false) as j_lt20, coalesce(kdj_j > 95, false) as j_gt95, coalesce(close >= 0.975e0*ma_20 and close <= 1.03e0*ma_20 and kdj_j < 45 and ma_20 >= ma_60, false) as bt_pattern, coalesce(vol_ratio >= 1.8e0 and change_pct > 2, false) as vol_breakout,
  coalesce(vol_ratio < 0.65e0 and change_pct > -3 and change_pct < 0.5e0, false) as shrink_pullback, coalesce(hist > 0 and hist_before <= 0, false) as macd_gold, coalesce(close <= boll_lower*1.01e0, false) as boll_touch_lower, coalesce(rsi_6 < 20, false) as rsi6_lt20 from fr)"""


def graded(spark, d, taken=None):
    """Bars with returns, kdj_j, rsi_6 and flags, of the as-of places if taken() is given: one pass over the bars, which aren't kept."""
    returns = ev.horizon_returns(ev.entry_fill(cb.daily_once(spark, d), 1.5))
    return ev.flagged_bars(returns, taken)


@query("e7_conditions", f"{CONDITIONS} select symbol, date, {', '.join(ev.FLAGS)} from fl")
def _(spark, d):
    return ev.flagged_bars(cb.daily_once(spark, d)).select("symbol", "date", *ev.FLAGS)


#: Point-in-time rows of the pooled statistics: J and RSI stand for scores.
PIT = f"{CONDITIONS}, pit as materialized (select * from {GRID.format(RETURNS.format('fl'))} _p)"


def pit(spark, d):
    read = ["symbol", "date", "fillable", *(f"ret_{h}" for h in ev.HORIZONS), "kdj_j", "rsi_6", "bt_pattern", "ma_bull", "ma_bear"]
    return cb.kept("pit", spark, d, lambda: graded(spark, d, ev.on_grid()).select(read))


_RATES = " ".join(rate_columns(f"ret_{h}") for h in ev.HORIZONS)
_BLOCKS = ", ".join(rate_sql(f"ret_{h}", f"ret_{h}") for h in ev.HORIZONS)


@query("e8_rate_block", f"{PIT} select symbol, {rate_sql('ret_10', 'ret')} from pit group by symbol", rate_columns("ret"))
def _(spark, d):
    return pit(spark, d).groupBy("symbol").agg(*stats.rate_block(F.col("ret_10"), "ret"))


@query("e9_baseline", f"{PIT} select count(*) as points, 100*avg(case when fillable then 0e0 else 1e0 end) as unfillable_pct, {_BLOCKS} from pit", "unfillable_pct " + _RATES)
def _(spark, d):
    return ev.baseline(pit(spark, d))


SIGNAL = "case when bt_pattern then 'pattern' when ma_bull then 'bull' when ma_bear then 'bear' else 'other' end"


@query("e10_by_group", f"{PIT}, g as (select {SIGNAL} as signal, {rate_sql('ret_10', 'ret')} from pit group by 1), b as (select {rate_sql('ret_10', 'base')} from pit) select g.*, ret_hit - base_hit as lift_hit, ret_mean - base_mean as lift_mean, 100e0*ret_n/base_n as share from g, b", rate_columns("ret") + " lift_hit lift_mean share")
def _(spark, d):
    return ev.by_group(pit(spark, d).withColumn("signal", F.expr(SIGNAL)), "signal")


def _ranks(by: str) -> str:
    return ", ".join(f"rank() over (partition by {by} order by {v}) + (count(*) over (partition by {by}, {v}) - 1)/2e0 as r{v}" for v in "xy")


@query("e11_rank_ic", f"""{PIT}, m as (select 'kdj_j' as score, date, round(kdj_j, 6) as x, ret_10 as y from pit where kdj_j is not null and ret_10 is not null union all select 'rsi_6', date, round(rsi_6, 6), ret_10 from pit where rsi_6 is not null and ret_10 is not null),
po as (select score, count(*) as n, case when count(*) >= 5 then corr(rx, ry) end as pooled_ic from (select *, {_ranks('score')} from m) _p group by score),
da as (select score, date, case when count(*) >= 8 and count(distinct x) >= 2 and count(distinct y) >= 2 then corr(rx, ry) end as ic from (select *, {_ranks('score, date')} from m) _d group by score, date)
select score, max(n) as n, max(pooled_ic) as pooled_ic, count(ic) as days, case when count(ic) >= 5 then avg(ic) end as mean_ic, case when count(ic) >= 5 then stddev_samp(ic) end as std_ic, case when count(ic) >= 5 then avg(ic)/stddev_samp(ic) end as icir, case when count(ic) >= 5 then avg(ic)/stddev_samp(ic)*sqrt(count(ic)) end as t from po left join (select * from da where ic is not null) da using (score) group by score""", "pooled_ic mean_ic std_ic icir t")
def _(spark, d):
    return ev.rank_ic(pit(spark, d).withColumns({c: F.round(c, 6) for c in ("kdj_j", "rsi_6")}), ["kdj_j", "rsi_6"])


@query("e12_quintiles", f"{PIT}, q as (select round(kdj_j, 6) as x, ret_10 as y, row_number() over (order by round(kdj_j, 6), date, symbol) as r, count(*) over () as n from pit where kdj_j is not null and ret_10 is not null) select greatest(1, ceil((r - 1)*5/(n - 1)))::int as quintile, {rate_sql('y', 'ret')}, min(x) as from_score, max(x) as to_score from q group by 1", rate_columns("ret") + " from_score to_score")
def _(spark, d):
    return ev.score_quintiles(pit(spark, d).withColumn("kdj_j", F.round("kdj_j", 6)), "kdj_j")


@query("e13_groups", f"{PIT} select case when kdj_j < 40 then '0-40' when kdj_j < 50 then '40-50' when kdj_j < 60 then '50-60' when kdj_j < 70 then '60-70' when kdj_j < 80 then '70-80' else '80-101' end as \"group\", {rate_sql('ret_10', 'ret')}, avg(case when ret_10 is not null then kdj_j end) as score_mean from pit where kdj_j >= 0 and kdj_j < 101 group by 1", rate_columns("ret") + " score_mean")
def _(spark, d):
    return ev.score_groups(pit(spark, d), "kdj_j")


#: Every bar, not only those of the as-of grid, whose entry can be filled.
EVERY = f"{CONDITIONS}, every as materialized (select * from {GRID.replace('% 3 = 0', '% 1 = 0').format(RETURNS.format('fl'))} _p where fillable)"


def _flag_sql(flag: str, holds: str) -> str:
    blocks = ", ".join(rate_sql(f"(case when {holds} then ret_{h} end)", f"ret_{h}") for h in ev.HORIZONS)
    return f"select '{flag}' as flag, 100*avg(case when {holds} then 1e0 else 0e0 end) as frequency, {blocks} from every"


_FLAGS = " union all ".join([_flag_sql(f, f) for f in ev.FLAGS] + [_flag_sql("baseline", "true")])


@query(
    "e18_condition_rates",
    f"{EVERY}, r as materialized ({_FLAGS}) select r.*, r.ret_10_hit - b.ret_10_hit as lift_hit, r.ret_10_mean - b.ret_10_mean as lift_mean from r, (select * from r where flag = 'baseline') b",
    "frequency lift_hit lift_mean " + _RATES,
)
def _(spark, d):
    return ev.condition_base_rates(graded(spark, d, ev.on_grid(step=1)).where("fillable"))


@query("e19_significance", f"{PIT}, g as (select {SIGNAL} as signal, {rate_sql('ret_10', 'ret')} from pit group by 1), b as (select {rate_sql('ret_10', 'base')} from pit) select signal, ret_n, ret_low is null or base_hit between ret_low and ret_high as covers_base from g, b")
def _(spark, d):
    rows = pit(spark, d).withColumn("signal", F.expr(SIGNAL))
    groups = ev.by_group(rows, "signal")
    return ev.significance_flags(groups, F.col("ret_hit") - F.col("lift_hit")).select("signal", "ret_n", "covers_base")


@query("e20_eligibility", f"{B}, a as ({cb.FALLBACK}), t as (select symbol, min(source) as source, min(adjustment) as adjustment, count(*) as bars from a group by symbol) select symbol, source, adjustment, adjustment = 'qfq' as eligible, bars, adjustment = 'qfq' and bars >= 272 as evaluated from t")
def _(spark, d):
    tags = src.series_tags(tagged(spark, d)[1])
    return ev.eligibility(tags, tags).select("symbol", "source", "adjustment", "eligible", "bars", "evaluated")


QUERIES = {k: v for k, v in cb.QUERIES.items() if k not in _LOCAL}
ORACLE = {k: cb.ORACLE[k] for k in QUERIES if k in cb.ORACLE}
