"""Queries over direction and resonance operators on index series, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import direction as dr
from candela.operators import levels as lev
from candela.operators import normalise as norm
from candela.operators import resonance as rs
from candela.plans import catalog_bars as cb
from candela.plans.catalog_bars import ATR, CHANGE, WEEK, mean_sql, portable, query, recursion_cte, run_sql
from candela.plans.catalog_eval import index
from candela.plans.catalog_structure import LEVELS, candidates, closes, half_hourly
from candela.plans.fixtures import HALF_HOURLY, HOURLY, INDEX_DAILY
from candela.sources.bars import latest

_LOCAL = set(cb.QUERIES)


def hourly(spark, d):
    return cb.kept("hourly", spark, d, lambda: norm.roll_up(half_hourly(spark, d), "hour"))


def weekly(spark, d):
    return norm.weekly(index(spark, d)).drop("amount")


def frames(spark, d):
    make = {"day": lambda: index(spark, d), "week": lambda: weekly(spark, d), "hour": lambda: hourly(spark, d), "half": lambda: half_hourly(spark, d)}
    return {k: cb.kept(f"direction-{k}", spark, d, lambda m=m: dr.directions(m())) for k, m in make.items()}


def direction_cte(bars: str, tag: str) -> str:
    atr = ATR.replace("from bars", f"from {bars}")
    return f"""{recursion_cte(bars, tag)},
_d{tag} as (select b.symbol, b.date, b.close, {mean_sql('close', 20).replace('close', 'b.close').replace('order by date', 'order by b.date').replace('by symbol', 'by b.symbol')} as ma_20, {mean_sql('close', 60).replace('close', 'b.close').replace('order by date', 'order by b.date').replace('by symbol', 'by b.symbol')} as ma_60, atr, dif, hist, kdj_j,
    coalesce(lag(hist) over w, hist) as hb, coalesce((b.close - lag(b.close, 4) over w)/4, 0) as ch, count(*) over (partition by b.symbol) as n
  from {bars} b join rec{tag} using (symbol, date) join (select symbol, date, atr from {atr} _a) a using (symbol, date) window w as (partition by b.symbol order by b.date)),
dir{tag} as materialized (select symbol, date, close, dif, hist, kdj_j, n, """ + portable("round(ch/(atr + 1e-9), 2) as slope, round(greatest(-0.95e0, least(0.95e0, 0.3e0*tanh((close - coalesce(ma_20, close))/(0.5e0*greatest(atr, close*0.005e0))) + 0.2e0*tanh((coalesce(ma_20, close) - coalesce(ma_60, close))/(0.5e0*greatest(atr, close*0.005e0))) + case when hist > 0 and hist >= hb then 0.35e0 when hist > 0 then 0.15e0 when hist < 0 and hist <= hb then -0.35e0 when hist < 0 then -0.15e0 else 0e0 end + case when kdj_j < 30 then 0.1e0 when kdj_j > 90 then -0.15e0 else 0e0 end)), 2) as score") + f" from _d{tag})"


X = f"with recursive bars as materialized ({INDEX_DAILY}), week as materialized (select symbol, {WEEK} as date, min_by(open, date) as open, max(high) as high, min(low) as low, max_by(close, date) as close, sum(volume) as volume from bars group by symbol, {WEEK}), hour as materialized (select symbol, ts as date, open, high, low, close, volume from ({HOURLY}) h), half as materialized (select symbol, ts as date, open, high, low, close, volume from ({HALF_HOURLY}) q)"
DAY, ALL = f"{X}, {direction_cte('bars', '_d')}", f"{X}, {direction_cte('bars', '_d')}, {direction_cte('week', '_w')}, {direction_cte('hour', '_h')}, {direction_cte('half', '_q')}"
LABEL = "case when {0} >= 0.2e0 then 'bull' when {0} >= 0.1e0 then 'weak_bull' when {0} <= -0.2e0 then 'bear' when {0} <= -0.1e0 then 'weak_bear' else 'neutral' end"
STATUS = "case when n < 15 then 'insufficient' when score >= 0.3e0 then 'rising' when score >= 0.1e0 then 'firm' when score <= -0.3e0 then 'pressed' else 'range' end"
PHASE = "case when hist > 0 and dif >= 0 then 'above_growing' when hist > 0 then 'below_mending' when dif < 0 then 'below_widening' else 'above_fading' end"
for _name, _sql, _columns in (
    ("d1_slope", "slope", "slope"), ("d2_score", "score", "score"), ("d4_status", f"{STATUS} as status", "status"), ("d5_phase", f"{PHASE} as phase", "phase"), ("d6_label", f"{LABEL.format('score')} as label", "label"),
    ("d3_rebound", portable("round(greatest(0e0, least(30e0, (40 - kdj_j)*0.4e0)), 1) as rebound, round(greatest(5e0, least(28e0, (kdj_j - 40)*0.35e0 + 5*greatest(slope, 0e0))), 1) as pullback"), "rebound pullback"),
):
    query(_name, f"{DAY} select symbol, date, {_sql} from dir_d")(lambda spark, d, c=_columns: frames(spark, d)["day"].select("symbol", "date", *c.split()))

MONTHS = portable("""
mo as (select symbol, cast(date_trunc('month', date) as date) as date, max_by(close, date) as close from week group by 1, 2),
mt as (select *, case when count(close) over w6 >= 6 then avg(close) over w6 end as ma6, case when count(close) over w12 >= 12 then avg(close) over w12 end as ma12, (close/lag(close, 3) over (partition by symbol order by date) - 1)*100 as chg3, row_number() over (partition by symbol order by date) as months
  from mo window w6 as (partition by symbol order by date rows between 5 preceding and current row), w12 as (partition by symbol order by date rows between 11 preceding and current row)),
ms as (select symbol, months, round(greatest(-1e0, least(1e0, case when close > ma6 then 0.4e0 else -0.4e0 end + case when ma12 is null then 0e0 when ma6 > ma12 then 0.3e0 else -0.3e0 end + greatest(-0.3e0, least(0.3e0, chg3/20)))), 2) as score from mt qualify row_number() over (partition by symbol order by date desc) = 1)""")


@query("d7_monthly", f"{X}, {MONTHS} select *, {LABEL.format('score')} as label from ms")
def _(spark, d):
    return dr.monthly_trend(weekly(spark, d))


def scores(spark, d):
    out = None
    for name, frame in (("weekly", "week"), ("daily", "day"), ("intraday", "hour")):
        one = latest(frames(spark, d)[frame].select("symbol", "date", "score")).select("symbol", F.col("score").alias(name))
        out = one if out is None else out.join(one, "symbol")
    return out


_LAST = "(select symbol, score, label, status from (select *, {label} as label, {status} as status from {0}) _l qualify row_number() over (partition by symbol order by date desc) = 1)".replace("{label}", LABEL.format("score")).replace("{status}", STATUS)


@query("d8_licence", f"""{ALL}, s as (select w.symbol, w.score as weekly, d.score as daily, h.score as intraday from {_LAST.format('dir_w')} w join {_LAST.format('dir_d')} d using (symbol) join {_LAST.format('dir_h')} h using (symbol)),
l as (select *, case when weekly >= 0.2e0 and daily >= 0.2e0 then 'long' when weekly < 0 and daily < 0 then 'defend' when weekly*daily < 0 and least(abs(weekly), abs(daily)) >= 0.1e0 then 'conflict' when weekly >= 0.1e0 and daily >= 0 and intraday > 0 then 'range' else 'wait' end as licence from s)
select *, case licence when 'long' then '70-85' when 'defend' then '10-30' when 'range' then '50-65' else '30-50' end as position_pct from l""")
def _(spark, d):
    return dr.op_license(scores(spark, d))


@query("d9_key_levels", f"{LEVELS}, " + portable("""k as (select symbol, max(case when label = 'S1' then centre end) as a1, max(case when label = 'S2' then centre end) as a2, max(case when label = 'R1' then centre end) as b1, max(case when label = 'R2' then centre end) as b2 from ranked group by symbol),
k1 as (select ld.symbol, close, coalesce(a1, round(close*0.985e0, 2)) as s1, coalesce(b1, round(close*1.025e0, 2)) as r1, a2, b2 from ld left join k using (symbol))
select symbol, close, s1, coalesce(a2, round(s1*0.98e0, 2)) as s2, r1, coalesce(b2, round(r1*1.02e0, 2)) as r2 from k1"""))
def _(spark, d):
    bars = cb.daily(spark, d)
    return dr.key_levels(closes(bars), lev.levels(candidates(spark, d), closes(bars)))


@query("d10_summary", f"{ALL} " + " union all ".join(f"select symbol, '{n}' as timeframe, label, score, status from {_LAST.format(t)} _x" for n, t in (("day", "dir_d"), ("week", "dir_w"), ("hour", "dir_h"), ("half", "dir_q"))))
def _(spark, d):
    out = dr.timeframe_summary(frames(spark, d))
    return out.select("symbol", F.explode("timeframes").alias("timeframe", "v")).select("symbol", "timeframe", "v.label", "v.score", "v.status")


def resonance(spark, d):
    return cb.kept("resonance", spark, d, lambda: rs.resonance(index(spark, d)))


_P = "over (partition by symbol order by date rows between {0} preceding and current row)"
RSV = f"case when row_number() over (partition by symbol order by date) <= 8 or max(high) {_P.format(8)} = min(low) {_P.format(8)} then 50e0 else (close - min(low) {_P.format(8)})/nullif(max(high) {_P.format(8)} - min(low) {_P.format(8)}, 0)*100 end"
RUNS = run_sql("close > before", "up_run", run_sql("close < before", "down_run", "(select *, lag(close) over (partition by symbol order by date) as before, row_number() over (partition by symbol order by date) - 1 as i from bars)"))
TRUE_RANGE = cb.TR
M = f"""{X}, {recursion_cte('bars', '_m', RSV)},
m0 as materialized (select *, close - before as delta, {TRUE_RANGE} as tr from {RUNS} _r),
m1 as (select *, sum(greatest(delta, 0)) {_P.format(13)}/14 as gain, sum(greatest(-delta, 0)) {_P.format(13)}/14 as loss, avg(tr) {_P.format(13)} as atr14, coalesce({mean_sql('close', 20)}, close) as m20, avg(volume) {_P.format(4)}/avg(volume) {_P.format(19)} as vr, coalesce((close/lag(close, 5) over (partition by symbol order by date) - 1)*100, 0) as ch, lag(close, 2) over (partition by symbol order by date) as c2 from m0),
m2 as (select m1.*, r.dif, r.dea, r.hist as h0, kdj_k, kdj_d, kdj_j, coalesce(lag(r.hist) over w, 0) as hp, coalesce(lag(r.dif - r.dea) over w, 0) as gp, coalesce(lag(kdj_k - kdj_d) over w, 0) as kp from m1 join rec_m r using (symbol, date) window w as (partition by symbol order by date)),
m3 as materialized (select symbol, date, i, close, down_run, up_run, atr14, dif, dea, gp, kdj_k, kdj_d, kp, c2, round(case when i < 14 then 50e0 else 100 - 100/(1 + case when loss = 0 then 100e0 else gain/nullif(loss, 0) end) end, 10) as rsi14, round(kdj_j, 10) as j, round((close - m20)/m20*100, 10) as deviation, round(h0, 10) as hist, round(hp, 10) as prev_hist, round(vr, 10) as vol_ratio, round(ch, 10) as chg_5 from m2),
m4 as (select *, case when rsi14 < 20 then 25 when rsi14 < 30 then 18 when rsi14 < 40 then 8 else 0 end + case when j < 0 then 20 when j < 10 then 14 when j < 20 then 7 else 0 end + case when deviation < -5 then 22 when deviation < -3 then 14 when deviation < -1.5e0 then 6 else 0 end
    + case when hist < 0 and prev_hist < 0 and hist > prev_hist then 10 else 0 end + case when down_run >= 5 then 15 when down_run >= 3 then 8 else 0 end + case when vol_ratio < 0.6e0 and deviation < -2 then 10 else 0 end + case when chg_5 < -8 then 12 when chg_5 < -5 then 6 else 0 end as rd,
  case when rsi14 > 80 then 25 when rsi14 > 70 then 18 when rsi14 > 60 then 8 else 0 end + case when j > 100 then 20 when j > 90 then 14 when j > 80 then 7 else 0 end + case when deviation > 5 then 22 when deviation > 3 then 14 when deviation > 1.5e0 then 6 else 0 end
    + case when hist > 0 and prev_hist > 0 and hist < prev_hist then 10 else 0 end + case when up_run >= 5 then 15 when up_run >= 3 then 8 else 0 end + case when vol_ratio > 1.8e0 and deviation > 2 then 10 else 0 end + case when chg_5 > 8 then 12 when chg_5 > 5 then 6 else 0 end as cd,
  {portable('round(greatest(-1e0, least(1e0, coalesce(case when gp <= 0 and dif - dea > 0 then 0.3e0 when gp >= 0 and dif - dea < 0 then -0.3e0 else greatest(-0.3e0, least(0.3e0, 4*((dif - dea) - gp)/nullif(atr14, 0))) end, 0) + case when kp <= 0 and kdj_k - kdj_d > 0 then 0.2e0 when kp >= 0 and kdj_k - kdj_d < 0 then -0.2e0 else 0e0 end + greatest(-0.3e0, least(0.3e0, coalesce((close/c2 - 1)*10, 0e0))))), 2)')} as g from m3),
m5 as materialized (select *, list(rd) filter (i >= 30) {_P.format(249)} as rds, list(cd) filter (i >= 30) {_P.format(249)} as cds from m4),
m6 as materialized (select *, {portable('coalesce(round(100e0*len(list_filter(rds, lambda v: v <= rd))/nullif(len(rds), 0), 1), 0e0)')} as rd_pct, {portable('coalesce(round(100e0*len(list_filter(cds, lambda v: v <= cd))/nullif(len(cds), 0), 1), 0e0)')} as cd_pct from m5)"""
CHIP = "case when {0} >= 60 then 'extreme' when {0} >= 40 then 'marked' when {0} >= 25 then 'moderate' when {0} >= 10 then 'weak' else 'neutral' end"
GSTATE = "case when g >= 0.15e0 then 'turning_up' when g <= -0.15e0 then 'turning_down' when g > 0.05e0 then 'leaning_up' when g < -0.05e0 then 'leaning_down' else 'neutral' end"
for _name, _sql, _columns, _doubles in (
    ("m1_features", "rsi14, j, deviation, hist, prev_hist, down_run, up_run, vol_ratio, chg_5", "rsi14 j deviation hist prev_hist down_run up_run vol_ratio chg_5", "rsi14 j deviation hist prev_hist vol_ratio chg_5"),
    ("m2_scores", "rd, cd", "rd cd", ""), ("m3_trigger", "g", "g", ""), ("m4_percentiles", "rd_pct, cd_pct", "rd_pct cd_pct", ""),
    ("m5_labels", f"{CHIP.format('rd')} as rd_label, {CHIP.format('cd')} as cd_label, {GSTATE} as g_label", "rd_label cd_label g_label", ""),
):
    query(_name, f"{M} select symbol, date, {_sql} from m6", _doubles)(lambda spark, d, c=_columns: resonance(spark, d).select("symbol", "date", *c.split()))

STAGE = f"""t0 as (select *, coalesce({mean_sql('close', 5)}, close) as m5, coalesce({mean_sql('close', 20)}, close) as m20, first_value(close) {_P.format(5)} as c0 from bars),
t1 as materialized (select symbol, date, round(case when close > m5 then 0.2e0 else -0.2e0 end + case when close > m20 then 0.3e0 else -0.3e0 end + case when m5 > m20 then 0.2e0 else -0.2e0 end + case when (close - c0)/c0*100 > 3 then 0.2e0 when (close - c0)/c0*100 < -3 then -0.2e0 else 0e0 end, 4) as trend_score from t0),
stage as (select *, case when trend_score > 0.5e0 then 'bull' when trend_score > 0.2e0 then 'weak_bull' when trend_score < -0.5e0 then 'bear' when trend_score < -0.2e0 then 'weak_bear' else 'neutral' end as trend_label from t1)"""


@query("m6_stage", f"{X}, {STAGE} select * from stage")
def _(spark, d):
    return rs.stage_trend(index(spark, d)).select("symbol", "date", "trend_score", "trend_label")


def board(spark, d):
    """One row an index: its last resonance row with the labels and scores of every timeframe."""

    def make():
        f = frames(spark, d)
        out = latest(resonance(spark, d).select("symbol", "date", "rd", "cd", "g")).join(latest(rs.stage_trend(index(spark, d)).select("symbol", "date", "trend_score")).drop("date"), "symbol")
        for name, label, part in (("score_week", "weekly_label", "week"), ("score_day", None, "day"), ("score_60m", None, "hour"), ("score_30m", None, "half")):
            one = latest(f[part].select("symbol", "date", "score", "label")).select("symbol", F.col("score").alias(name), *([F.col("label").alias(label)] if label else []))
            out = out.join(one, "symbol")
        out = out.join(dr.monthly_trend(weekly(spark, d)).select("symbol", F.col("label").alias("monthly_label")), "symbol")
        return rs.direction_confirmation(rs.confirmation_ladder(rs.maturity(rs.decision(rs.permission_cap(out)))))

    return cb.kept("board", spark, d, make)


BOARD = f"""{M}, {STAGE}, {direction_cte('bars', '_d')}, {direction_cte('week', '_w')}, {direction_cte('hour', '_h')}, {direction_cte('half', '_q')}, {MONTHS},
b0 as (select m.symbol, rd, cd, g, trend_score, w.score as score_week, w.label as weekly_label, d.score as score_day, h.score as score_60m, q.score as score_30m, {LABEL.format('ms.score')} as monthly_label
  from (select * from m6 qualify row_number() over (partition by symbol order by date desc) = 1) m join (select * from stage qualify row_number() over (partition by symbol order by date desc) = 1) s using (symbol)
  join {_LAST.format('dir_w')} w using (symbol) join {_LAST.format('dir_d')} d using (symbol) join {_LAST.format('dir_h')} h using (symbol) join {_LAST.format('dir_q')} q using (symbol) join ms using (symbol)),
b1 as (select *, case monthly_label when 'bear' then 'light' when 'weak_bear' then 'half' else 'normal' end as cap from b0),
b2 as (select *, case when weekly_label in ('bear', 'weak_bear') or trend_score < -0.3e0 then 'pause' when trend_score > 0.6e0 and weekly_label = 'bull' then case when cap = 'normal' then 'full' else 'half' end when trend_score > 0.3e0 then 'light' else 'watch' end as p0,
  case when score_60m > 0.1e0 and score_30m > 0.1e0 then 'both_up' when score_60m < -0.1e0 and score_30m < -0.1e0 then 'both_down' when score_60m > 0.1e0 and score_30m <= 0.1e0 then 'pullback' when score_60m <= -0.1e0 and score_30m > 0.1e0 then 'rebound' else 'range' end as rhythm from b1),
b3 as (select *, case when cap = 'light' and p0 in ('full', 'half', 'light') then 'light' else p0 end as permission from b2),
board as (select *, case when permission = 'pause' then case when weekly_label in ('bear', 'weak_bear') then 'weekly_forbids' else 'unclear' end when rd >= 40 and g >= 0.15e0 then 'rebound' when cd >= 40 and g <= -0.15e0 then 'pullback' when rd >= 25 then 'oversold_watch' when cd >= 25 then 'overbought_watch' else 'wait' end as action,
  least(100e0, floor(1.2e0*rd + 50*greatest(g, 0e0) + 0.5e0)) as rebound_ripe, least(100e0, floor(1.2e0*cd + 50*greatest(-g, 0e0) + 0.5e0)) as pullback_ripe, floor(30*score_day + 20*g + 0.5e0) as "trigger",
  case when abs(score_60m) >= 0.1e0 then 1 else 0 end + case when abs(score_day) >= 0.1e0 then 1 else 0 end + case when abs(score_week) > 0.3e0 then 1 else 0 end as confirmed,
  case when g >= 0.15e0 and score_day > 0.2e0 then 'up' when g <= -0.15e0 and score_day < -0.2e0 then 'down' else 'none' end as confirmation from b3)"""
for _name, _columns in (("m7_permission", "cap permission rhythm"), ("m8_decision", "action"), ("m9_maturity", "rebound_ripe pullback_ripe trigger"), ("m10_ladder", "confirmed"), ("m12_confirmation", "confirmation")):
    _quoted = ", ".join(f'"{c}"' for c in _columns.split())
    query(_name, f"{BOARD} select symbol, {_quoted} from board")(lambda spark, d, c=_columns: board(spark, d).select("symbol", *c.split()))


@query("m11_cold", f"with bars as ({INDEX_DAILY}), c as (select symbol, date, sum(case when change_pct < -1.5e0 then 1 else 0 end) {_P.format(4)} as n from {CHANGE} _c) select symbol, date, n::bigint as cold_days, case when n >= 3 then 'cold' when n >= 1 then 'cool' else 'normal' end as environment from c")
def _(spark, d):
    return rs.cold_environment(norm.change_pct(index(spark, d))).select("symbol", "date", "cold_days", "environment")


QUERIES = {k: v for k, v in cb.QUERIES.items() if k not in _LOCAL}
ORACLE = {k: cb.ORACLE[k] for k in QUERIES if k in cb.ORACLE}
