"""Queries over scores, plans and screens, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import indicators as ind
from candela.operators import levels as lev
from candela.operators import scoring as sc
from candela.plans import catalog_bars as cb
from candela.plans.catalog_bars import B, QUOTES, daily, portable, query, quotes
from candela.plans.catalog_structure import DIVERGENCE, FEATURES, LEVELS, MA, candidates, closes, part
from candela.plans.fixtures import INSTRUMENTS, derive

_LOCAL = set(cb.QUERIES)

STATE = f"""{LEVELS}, {DIVERGENCE}, {FEATURES},
state as materialized (select ld.*, rec.kdj_j, rec.hist, rec.dif, rec.dea, atrs.atr, vf.vol_ratio, nb.n, lw.close as week_close, lw.ma_20 as week_ma_20, lw.ma_60 as week_ma_60,
    poc.poc, profit.profit_ratio, conc.conc_90, dvg.bullish_divergence, dvg.bearish_divergence, ft.is_breakout, ft.is_shrink, ft.vp_state, ss.supports, rs.resistances
  from ld join rec using (symbol, date) join atrs using (symbol, date) join (select symbol, date, vol_ratio from vf) vf using (symbol, date) join features ft using (symbol, date)
  join (select symbol, count(*) as n from bars group by symbol) nb using (symbol) left join lw using (symbol) left join poc using (symbol) left join profit using (symbol) left join conc using (symbol)
  left join (select symbol, bullish_divergence, bearish_divergence from divergence) dvg using (symbol)
  left join (select symbol, list(centre order by nth) as supports from ranked where side = 'support' group by symbol) ss using (symbol)
  left join (select symbol, list(centre order by nth) as resistances from ranked where side = 'resistance' group by symbol) rs using (symbol)),
weights as (select *, case when n < 30 then [0.25e0, 0.25e0, 0.25e0, 0.25e0] when week_close > week_ma_20 and week_ma_20 > week_ma_60 and close > ma_20 and ma_20 > ma_60 then [0.35e0, 0.2e0, 0.2e0, 0.25e0]
    when week_close < week_ma_20 and week_ma_20 < week_ma_60 and close < ma_20 and ma_20 < ma_60 then [0.35e0, 0.2e0, 0.25e0, 0.2e0] when kdj_j < 20 or kdj_j > 90 then [0.2e0, 0.25e0, 0.35e0, 0.2e0]
    when atr/(close + 1e-9) < 0.015e0 then [0.2e0, 0.3e0, 0.2e0, 0.3e0] else [0.25e0, 0.25e0, 0.25e0, 0.25e0] end as w from state),
scored as (select *, greatest(5e0, least(95e0, 50e0 + case when close > ma_20 and ma_20 > ma_60 then 20 else 0 end - case when close < ma_20 and ma_20 < ma_60 then 20 else 0 end
      + case when close > ma_20 and ma_20 > ma_60 and ma_60 > ma_120 then 10 else 0 end + case when week_close > week_ma_20 and week_ma_20 >= week_ma_60 then 20 else 0 end - case when week_close < week_ma_20 and week_ma_20 < week_ma_60 then 20 else 0 end)) as trend_score,
    case when week_close > week_ma_20 and week_ma_20 >= week_ma_60 then 'bull' when week_close < week_ma_20 and week_ma_20 < week_ma_60 then 'bear' else 'range' end as weekly_trend,
    greatest(5e0, least(95e0, 50e0 + case when profit_ratio >= 80 then 25 when profit_ratio >= 60 then 15 when profit_ratio <= 15 then -20 else 0 end + case when conc_90 <= 10 then 15 when conc_90 >= 25 then -10 else 0 end + case when close >= poc*0.98e0 and close <= poc*1.03e0 then 10 else 0 end)) as chip_score,
    supports[1] as s1, resistances[1] as r1, coalesce((close - supports[1])/close*100, 999e0) as s_dist, coalesce((resistances[1] - close)/close*100, 999e0) as r_dist from weights),
moved as (select *, greatest(5e0, least(95e0, 50e0 + case when hist > 0 and dif - dea > 0 then 15 when hist < 0 and dif - dea < 0 then -15 else 0 end + case when bullish_divergence then 25 else 0 end - case when bearish_divergence then 25 else 0 end
      + case when kdj_j < 20 and trend_score >= 45 then 15 when kdj_j < 20 then 5 when kdj_j > 95 then -15 else 0 end + case when is_breakout then 12 else 0 end + case when is_shrink then 8 else 0 end
      + case vp_state when 'bearish_vp' then -10 when 'bullish_vp' then 8 when 'panic' then -12 else 0 end)) as momentum_score,
    greatest(5e0, least(95e0, 50e0 - case when s1 is not null and s_dist < 0 then 20 else 0 end + case when r1 is null then 0 when r_dist between 0 and 1.2e0 then -20 when r_dist > 6 then 15 else 0 end)) as position_score,
    w[1]/(w[1] + w[2] + w[3]) as w_trend, w[2]/(w[1] + w[2] + w[3]) as w_chips, w[3]/(w[1] + w[2] + w[3]) as w_momentum from scored),
""" + portable("""
summed as (select *, round(least(100e0, greatest(0e0, trend_score*w_trend + chip_score*w_chips + momentum_score*w_momentum + position_score*0e0)), 1) as bullish_score from moved),
compl as (select *, round(100e0 - bullish_score, 1) as bearish_score, least(92e0, greatest(15e0, bullish_score)) as bullish_clipped from summed),
signals as (select *, case when bullish_score >= 75 and (s_dist <= 3 or coalesce(bullish_divergence, false)) then 'BUY_SUPPORT_PULLBACK' when bullish_score >= 70 and r_dist <= 1.5e0 and vol_ratio >= 1.5e0 then 'BUY_BREAKOUT'
    when bearish_score >= 65 and r_dist <= 1.5e0 then 'SELL_RESISTANCE_REJECT' when bearish_score >= 65 and s_dist < 0 then 'SELL_BREAKDOWN' else 'HOLD_WATCH' end as signal from compl),
p1 as (select *, round(coalesce(s1*0.992e0, close*0.985e0), 2) as entry_low, round(case when s1 is not null then greatest(close*1.003e0, s1*1.015e0) else close*1.005e0 end, 2) as entry_high, list_filter(resistances, lambda r: (r - close)/close*100 >= 3) as far from signals),
p2 as (select *, round(greatest(case when s1 is not null then least(s1*0.975e0, entry_low - 3*atr) else close - 3*atr end, close*0.88e0), 2) as stop_loss, round(coalesce(far[1], r1, close*1.08e0), 2) as tp_1 from p1),
p3 as (select *, round(coalesce((list_filter(far, lambda r: r > tp_1*1.001e0))[1], tp_1*1.06e0), 2) as tp_2, round((tp_1 - close)/close*100 - 1, 2) as gain_pct, round((close - stop_loss)/close*100 + 1, 2) as loss_pct from p2),
p4 as (select *, case when loss_pct > 0 and gain_pct > 0 then round(gain_pct/loss_pct, 2) else 0e0 end as rr_ratio, case when bullish_score >= 70 then 'short' else 'medium' end as holding from p3),
plans as (select *, case when rr_ratio <= 0 then 'no_entry' when rr_ratio >= 3 then 'excellent' when rr_ratio >= 2 then 'good' else 'ordinary' end as rr_quality from p4),
tests as (select *, round(kdj_j, 1) as j1, round(vol_ratio, 2) as v2 from plans),
screened as (select *, array_to_string(list_filter([case when s_dist between 0 and 2.5e0 and (j1 < 30 or signal = 'BUY_SUPPORT_PULLBACK') and rr_ratio >= 2.2e0 then 'SUPPORT_PULLBACK' end, case when v2 >= 1.6e0 and r_dist between -1.5e0 and 2.5e0 and profit_ratio >= 70 then 'BREAKOUT_PRESSURE' end,
    case when weekly_trend = 'bull' and conc_90 <= 10 and close > poc*1.02e0 then 'MAIN_WAVE_TREND' end, case when (close <= boll_lower*1.01e0 or bullish_divergence) and j1 < 15 and v2 <= 1.2e0 then 'OVERSOLD_DIVERGENCE' end], lambda x: x is not null), ',') as strategies from tests)""")


def state(spark, d):
    return cb.kept("state", spark, d, lambda: _state(spark, d))


def _state(spark, d):
    parts = (part(name, spark, d) for name in ("day", "week", "profile"))
    return joined(*parts, lev.levels(candidates(spark, d), closes(daily(spark, d))))


def joined(day, week, profiled, bands):
    return sc.join_state(day, week, profiled.drop("peaks"), bands)


def state_of(bars, bands):
    """State rows of any series with date, prices and volume."""
    return joined(*(part(name, None, None, bars) for name in ("day", "week", "profile")), bands)


def scored(spark, d):
    return sc.score_all(state(spark, d)).withColumn("strategies", F.array_join("strategies", ","))


for _name, _table, _columns, _doubles in (
    ("c1_adaptive_weights", "weights", "", ""), ("c2_weights", "moved", "w_trend w_chips w_momentum", "w_trend w_chips w_momentum"), ("c3_trend_score", "scored", "trend_score weekly_trend", ""),
    ("c4_chip_score", "scored", "chip_score", ""), ("c5_momentum_score", "moved", "momentum_score", ""), ("c6_position_score", "moved", "s_dist r_dist position_score", "s_dist r_dist"),
    ("c7_composite", "compl", "bullish_score bearish_score bullish_clipped", ""), ("c8_signal", "signals", "signal", ""),
    ("c9_trade_plan", "plans", "entry_low entry_high stop_loss tp_1 tp_2 gain_pct loss_pct rr_ratio rr_quality holding", ""),
    ("c11_screens", "screened", "strategies", ""),
):
    if _name == "c1_adaptive_weights":
        query(_name, f"{STATE} select symbol, w[1] as w_trend, w[2] as w_chips, w[3] as w_momentum, w[4] as w_position from weights")(lambda spark, d: sc.adaptive_weights(state(spark, d)).select("symbol", *sc.WEIGHTS))
    else:
        query(_name, f"{STATE} select symbol, {', '.join(_columns.split())} from {_table}", _doubles)(lambda spark, d, c=_columns: scored(spark, d).select("symbol", *c.split()))


def _gain(h: int) -> str:
    f = f"over (partition by symbol order by date rows between 1 following and {h} following)"
    return f"(case when min(low) {f} <= stop then stop else lead(close, {h}) over (partition by symbol order by date) end - close)/close*100 - 1 as g{h}"


PATTERNS = f"""sp as (select b.*, atr, kdj_j, m.ma_20, m.ma_60, row_number() over (partition by b.symbol order by b.date) - 1 as i, count(*) over (partition by b.symbol) as n, b.close - 3*case when atr > 0 then atr else b.close*0.02e0 end as stop
    from bars b join atrs using (symbol, date) join rec using (symbol, date) join ({MA}) m using (symbol, date)),
sg as (select *, {_gain(5)}, {_gain(10)}, {_gain(20)} from sp), ac as (select symbol, s_dist <= 3 as near, kdj_j < 35 or coalesce(bullish_divergence, false) as low, trend_score >= 55 as up from signals),
sm as (select sg.symbol, i, g5, g10, g20 from sg join ac using (symbol) where (near or ac.low or up) and i between 30 and n - 21 and (not near or coalesce(close >= 0.975e0*ma_20 and close <= 1.03e0*ma_20, false)) and (not ac.low or kdj_j <= 45) and (not up or not coalesce(ma_60 > ma_20, false))),
sk as (select symbol, unnest(list_reduce(list([i] order by i), lambda a, x: case when x[1] - a[-1] >= 10 then list_concat(a, x) else a end)) as i from sm group by symbol),
sc as (select symbol, count(*) as samples, avg(case when g5 > 0 then 1e0 else 0e0 end) as w5, avg(case when g10 > 0 then 1e0 else 0e0 end) as w10, avg(case when g20 > 0 then 1e0 else 0e0 end) as w20, avg(g10) as m10 from sm join sk using (symbol, i) group by symbol)
""" + portable("""select s.symbol, coalesce(samples, 0)::bigint as samples, case when samples >= 5 then round(100*w5, 1) end as win_5, case when samples >= 5 then round(100*w10, 1) end as win_10, case when samples >= 5 then round(100*w20, 1) end as win_20, case when samples >= 5 then round(m10, 1) end as mean_10, case when samples >= 5 then 'sufficient' else 'insufficient' end as status from signals s left join sc on sc.symbol = s.symbol""")


@query("c10_similar_patterns", f"{STATE}, {PATTERNS}")
def _(spark, d):
    bars = daily(spark, d)
    frame = ind.recursions(ind.atr(ind.sma(bars, (20, 60))))
    return sc.similar_patterns(frame, sc.distances(sc.trend_score(state(spark, d))))


@query("c12_universe_filter", f"{B} select symbol, name, close, amount from {QUOTES} _q where close > 60 and amount > 2000 and name not like 'Supplier#00000001%' order by amount desc, symbol limit 50")
def _(spark, d):
    return sc.universe_filter(quotes(spark, d), 50, 60.0, 2000.0, ("Supplier#00000001",)).select("symbol", "name", "close", "amount")


@query("c13_scan_rank", f"{STATE} select symbol, bullish_score, rr_ratio, strategies from screened where strategies <> ''")
def _(spark, d):
    ranked = sc.scan_rank(sc.score_all(state(spark, d)))
    return ranked.select("symbol", "bullish_score", "rr_ratio", F.array_join("strategies", ",").alias("strategies"))


@query("c14_search", f"select * from ({INSTRUMENTS}) i where upper(name) like '%7%' or cast(symbol as varchar) like '%7%' or upper(industry) like '%7%' order by symbol limit 60")
def _(spark, d):
    return sc.instrument_search(derive(spark, d, INSTRUMENTS), " 7 ")


QUERIES = {k: v for k, v in cb.QUERIES.items() if k not in _LOCAL}
ORACLE = {k: cb.ORACLE[k] for k in QUERIES if k in cb.ORACLE}
