"""Queries over sources, normalisation and indicators, each with its DuckDB SQL."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.windows import KEY
from candela.operators import indicators as ind
from candela.operators import normalise as norm
from candela.plans.fixtures import DAILY, FUNDING, INDEX_DAILY, INSTRUMENTS, PRICED, daily_bars, derive, index_daily
from candela.sources import bars as src

QUERIES, ORACLE = {}, {}


def portable(sql: str) -> str:
    """The text with round(x, n) spelled as floor(x * 10^n + 0.5) / 10^n: halves go upwards on every engine."""
    while (m := re.search(r"\bround\(", sql)) is not None:
        depth, comma, at = 1, None, m.end()
        while depth:
            c = sql[at]
            depth += (c in "([") - (c in ")]")
            comma = at if c == "," and depth == 1 else comma
            at += 1
        scale = f"1e{int(sql[comma + 1 : at - 1])}"
        sql = f"{sql[: m.start()]}(floor(({sql[m.end() : comma]}) * {scale} + 0.5e0) / {scale}){sql[at:]}"
    return sql


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; sql: its oracle; doubles: columns that both sides round to six digits."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(c, 6) for c in doubles.split()}) if doubles else out

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in doubles.split())}) from ({sql}) _q" if doubles else sql
        return f

    return put


_KEPT: dict[tuple, DataFrame] = {}


def kept(name: str, spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A table that several queries of a run read: made once for each folder and persisted (memory, then disk)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT or not _KEPT[key].is_cached:
        _KEPT[key] = make().persist()
    return _KEPT[key]


_MADE: dict[tuple, object] = {}


def made(name: str, spark: SparkSession, sf_dir: str, make):
    """What several queries of a run share and make() has stored: made once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept("daily", spark, sf_dir, lambda: daily_bars(spark, sf_dir))


def daily_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily() for a query that reads it in one pass: it takes what the run has persisted, but persists nothing itself."""
    found = _KEPT.get((spark.sparkContext.applicationId, sf_dir, "daily"))
    return found if found is not None and found.is_cached else daily_bars(spark, sf_dir)


def code(symbol: str = "symbol") -> str:
    """A six-digit code for each symbol, over all boards."""
    return f"lpad(cast({symbol} * 7919 % 1000000 as varchar(6)), 6, '0')"


TAGGED = "select *, 'alpha' as source, 'qfq' as adjustment from bars where symbol % 3 <> 0"
FALLBACK = "select *, 'beta' as source, case when symbol % 2 = 0 then 'qfq' else 'raw' end as adjustment from bars"
B = f"with bars as ({DAILY})"
CHANGE = "(select *, round((close - base) / base * 100, 2) as change_pct from (select *, case when before > 0 then before else open end as base from (select *, lag(close) over (partition by symbol order by date) as before from bars) _a) _b)"


def tagged(spark, sf_dir):
    bars = daily(spark, sf_dir)
    first = bars.where("symbol % 3 <> 0").withColumns({"source": F.lit("alpha"), "adjustment": F.lit("qfq")})
    other = bars.withColumns({"source": F.lit("beta"), "adjustment": F.expr("case when symbol % 2 = 0 then 'qfq' else 'raw' end")})
    return first, other


@query("s1_bars_from_ticks", DAILY)
def _(spark, d):
    ticks = derive(spark, d, PRICED).select("symbol", "date", "rn", F.col("px").alias("price"), F.col("q").alias("volume"))
    return src.bars_from_ticks(ticks, F.col("date"), "rn")


@query("s2_scan_bars", f"{B} select * from bars qualify row_number() over (partition by symbol order by date desc) <= 250")
def _(spark, d):
    return src.scan_bars(daily(spark, d), 250)


@query("s3_source_fallback", f"{B}, a as ({TAGGED}), b as ({FALLBACK}) select * from a union all select * from b where symbol not in (select symbol from a)")
def _(spark, d):
    return src.source_fallback(*tagged(spark, d))


_TAG = "case when count(distinct {0}) = 1 and count({0}) = count(*) then min({0}) else 'unknown' end as {0}"


@query("s4_mixed_tags", f"{B}, a as ({TAGGED}), b as ({FALLBACK}), u as (select * from a union all select * from b) select symbol, {_TAG.format('source')}, {_TAG.format('adjustment')}, count(*) as bars from u group by symbol")
def _(spark, d):
    a, b = tagged(spark, d)
    return src.series_tags(a.unionByName(b))


@query("s5_instruments", f"{B}, i as ({INSTRUMENTS}) select l.symbol, l.close, coalesce(i.name, 'instrument ' || l.symbol) as name, coalesce(i.industry, 'main board') as industry from (select symbol, max_by(close, date) as close from bars group by symbol) l left join i on i.symbol = l.symbol and i.symbol % 4 <> 0")
def _(spark, d):
    last = src.latest(daily(spark, d)).select(KEY, "close")
    return src.with_instruments(last, derive(spark, d, INSTRUMENTS).where("symbol % 4 <> 0"))


QUOTES = f"(select b.*, i.name, i.industry from (select * from {CHANGE} _c qualify row_number() over (partition by symbol order by date desc) = 1) b left join ({INSTRUMENTS}) i using (symbol))"


def quotes(spark, d):
    return src.latest(norm.change_pct(daily(spark, d))).join(derive(spark, d, INSTRUMENTS), KEY, "left")


@query("s6_universe", f"{B} select symbol, date, close, amount, change_pct, name, industry from {QUOTES} _q where close > 0 order by amount desc, symbol limit 240")
def _(spark, d):
    return src.universe_snapshot(quotes(spark, d)).select("symbol", "date", "close", "amount", "change_pct", "name", "industry")


@query("s7_funding", FUNDING)
def _(spark, d):
    f = derive(spark, d, FUNDING)
    twice = f.withColumn("at", F.lit(1)).unionByName(f.select("date", (F.col("balance") * 0).alias("balance"), F.lit(0).alias("at")))
    return src.funding_series(twice, "at")


@query("s8_breadth", f"{B}, o as (select cast(o_orderdate as date) as date, count_if(o_orderpriority = '1-URGENT') as lu, count_if(o_orderpriority = '5-LOW') as ld from orders where o_custkey % 2 = 0 group by 1), c as (select date, count_if(change_pct > 0) as up, count_if(change_pct < 0) as down, count_if(change_pct = 0) as flat, count_if(change_pct >= 1.5e0) as limit_up, count_if(change_pct <= -1.5e0) as limit_down from {CHANGE} _c group by date) select c.date, up, down, flat, coalesce(lu, limit_up)::bigint as limit_up, coalesce(ld, limit_down)::bigint as limit_down from c left join o using (date)")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 2 = 0").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    official = orders.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("limit_up"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("limit_down"))
    return src.market_breadth(norm.change_pct(daily(spark, d)), official, limit=1.5)


@query("s9_index_snapshot", f"with bars as ({INDEX_DAILY}) select symbol, date, close, change_pct from {CHANGE} _c qualify row_number() over (partition by symbol order by date desc) = 1")
def _(spark, d):
    return src.index_snapshot(norm.change_pct(index_daily(spark, d)))


@query("t1_latest", f"{B} select * from bars qualify row_number() over (partition by symbol order by date desc) = 1")
def _(spark, d):
    return src.latest(daily(spark, d)).select(*daily(spark, d).columns)


@query("t2_keep_last", f"select symbol, date, rn, q, st from ({PRICED.replace('q, rn,', 'q, rn, st,')}) p qualify row_number() over (partition by symbol, date order by rn desc) = 1")
def _(spark, d):
    return src.dedupe_keep_last(derive(spark, d, PRICED.replace("q, rn,", "q, rn, st,")), "rn").select("symbol", "date", "rn", "q", "st")


@query("b1_change_pct", f"{B} select symbol, date, close, change_pct from {CHANGE} _c")
def _(spark, d):
    return norm.change_pct(daily(spark, d)).select("symbol", "date", "close", "change_pct")


@query("b2_units", f"{B}, b as ({FALLBACK}), a as ({TAGGED}) select symbol, date, source, volume * 100 as volume, amount from a union all select symbol, date, source, volume, amount * 1e4 from b", "volume amount")
def _(spark, d):
    a, b = tagged(spark, d)
    return norm.unit_normalise(a.unionByName(b), ("alpha",), ("beta",)).select("symbol", "date", "source", "volume", "amount")


_LIM = "case when regexp_matches({0}, '^(300|301|688|689)') then 20e0 {1} else 10e0 end"


@query("b3_limit_pct", f"select s_suppkey as symbol, {code('s_suppkey')} as code, {_LIM.format(code('s_suppkey'), '')} as limit_pct, {_LIM.format(code('s_suppkey'), 'when ' + 'regexp_matches(' + code('s_suppkey') + chr(44) + chr(39) + '^(92|4|8)' + chr(39) + ') then 30e0')} as limit_pct_30 from supplier")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"), F.expr(code("s_suppkey")).alias("code"))
    return s.withColumns({"limit_pct": norm.limit_pct(F.col("code")), "limit_pct_30": norm.limit_pct(F.col("code"), with_30=True)})


LIMITS = f"(select *, coalesce(change_pct >= 1.5e0 - 0.5e0 and close >= before * (1 + 1.5e0 / 100 - 0.001e0), false) as is_limit_up, coalesce(change_pct <= -(1.5e0 - 0.5e0) and close <= before * (1 - 1.5e0 / 100 + 0.001e0), false) as is_limit_down from {CHANGE} _l)"


@query("b4_limit_flags", f"{B} select symbol, date, change_pct, is_limit_up, is_limit_down from {LIMITS} _q")
def _(spark, d):
    return norm.limit_flags(norm.change_pct(daily(spark, d)), F.lit(1.5)).select("symbol", "date", "change_pct", "is_limit_up", "is_limit_down")


@query("b5_turnover", f"{B} select symbol, date, case when volume > 0 and symbol % 5 > 0 then round(volume / (symbol % 5 * 1e3) * 100, 4) else 0 end as turnover, 'estimated' as turnover_status, 'current_float_shares' as turnover_basis from bars")
def _(spark, d):
    shares = (F.col("symbol") % 5 * 1000.0).cast("double")
    shares = F.when(shares > 0, shares)
    return norm.turnover_estimate(daily(spark, d), shares).select("symbol", "date", "turnover", "turnover_status", "turnover_basis")


@query("b6_float_shares", f"{B}, q as (select symbol, max_by(close, date) as close from bars group by symbol), s as (select symbol, (symbol % 9) * 1e8 / close as s from q) select symbol, round(case when s > 1e6 and s < 5e11 then s else 5e8 end, 1) as float_shares from s")
def _(spark, d):
    last = src.latest(daily(spark, d))
    return last.select("symbol", F.round(norm.float_shares((F.col("symbol") % 9).cast("double"), F.col("close")), 1).alias("float_shares"))


@query("b7_amount", f"{B} select symbol, date, case when symbol % 2 = 0 then amount else volume * (open + close) / 2 end as amount from bars", "amount")
def _(spark, d):
    bars = daily(spark, d).withColumn("amount", F.expr("case when symbol % 2 = 0 then amount end"))
    return norm.amount_estimate(bars).select("symbol", "date", "amount")


@query("b8_exchange", f"select s_suppkey as symbol, {code('s_suppkey')} as code, case when regexp_matches({code('s_suppkey')}, '^(92|4|8)') then 'bj' when regexp_matches({code('s_suppkey')}, '^(60|68|90|11|51)') then 'sh' else 'sz' end as exchange from supplier")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"), F.expr(code("s_suppkey")).alias("code"))
    return s.withColumn("exchange", norm.exchange_prefix(F.col("code")))


_HOLES = "select symbol, date, case when symbol % 4 = 0 then 0e0 else open end as open, case when symbol % 3 = 0 then 0e0 else high end as high, case when symbol % 5 = 0 then 0e0 else low end as low, case when symbol % 11 = 0 then 0e0 else close end as close from bars"


@query("b9_zero_guard", f"{B}, h as ({_HOLES}), o as (select symbol, date, case when open > 0 then open else close end as open, high, low, close from h where close > 0) select symbol, date, open, case when high > 0 then high else greatest(close, open) end as high, case when low > 0 then low else least(close, open) end as low, close from o")
def _(spark, d):
    bars = daily(spark, d)
    for c, n in (("open", 4), ("high", 3), ("low", 5), ("close", 11)):
        bars = bars.withColumn(c, F.when(F.col("symbol") % n == 0, 0.0).otherwise(F.col(c)))
    return norm.zero_value_guard(bars.select("symbol", "date", "open", "high", "low", "close"))


WEEK = "cast(date + cast((12 - dayofweek(date)) % 7 as int) as date)"
WEEKLY = f"(select symbol, {WEEK} as week, min_by(open, date) as open, max(high) as high, min(low) as low, max_by(close, date) as close, sum(volume) as volume, round(sum(amount), 4) as amount from bars group by all)"


@query("b10_weekly", f"{B} select symbol, week as date, open, high, low, close, volume, amount, coalesce((close - lag(close) over (partition by symbol order by week)) / lag(close) over (partition by symbol order by week) * 100, 0) as change_pct, false as is_limit_up, false as is_limit_down from {WEEKLY} _w", "amount change_pct")
def _(spark, d):
    out = norm.weekly(daily(spark, d))
    return out.withColumn("amount", F.round("amount", 4))


@query("b11_monthly", f"{B}, w as (select symbol, week as date, open, high, low, close, volume, amount from {WEEKLY} _w) select symbol, cast(date_trunc('month', date) as date) as month, min_by(open, date) as open, max(high) as high, min(low) as low, max_by(close, date) as close, sum(volume) as volume, round(sum(amount), 4) as amount from w group by all")
def _(spark, d):
    out = norm.monthly(norm.weekly(daily(spark, d)).withColumn("amount", F.round("amount", 4)))
    return out.withColumnRenamed("date", "month").withColumn("amount", F.round("amount", 4))


@query("b12_drop_unfinished", f"{B} select symbol, date, close from bars where date < date '1997-06-02'")
def _(spark, d):
    return norm.drop_unfinished(daily(spark, d), datetime(1997, 6, 2, 14, 0)).select("symbol", "date", "close")


@query("b13_in_progress", f"{B} select symbol, max(date) as last_date, date_trunc('month', max(date)) = date '1998-11-01' as in_progress from bars group by symbol")
def _(spark, d):
    return norm.in_progress(daily(spark, d), "month", date(1998, 11, 15))


@query("b14_adjustment_gate", f"{B}, a as ({FALLBACK}), t as (select symbol, min(source) as source, min(adjustment) as adjustment from a group by symbol) select symbol, source, adjustment, adjustment = 'qfq' as eligible, adjustment = 'qfq' as weekly_used, case when adjustment = 'qfq' then '' else 'adjustment,weekly_dropped' end as warnings from t")
def _(spark, d):
    _, b = tagged(spark, d)
    tags = src.series_tags(b)
    gate = norm.adjustment_gate(tags, tags.withColumn("adjustment", F.lit("qfq")))
    return gate.withColumn("warnings", F.array_join("warnings", ","))


@query("b15_tail", f"{B} select symbol, date, round(close, 1) as close, volume from bars qualify row_number() over (partition by symbol order by date desc) <= 120")
def _(spark, d):
    return norm.tail(daily(spark, d), 120, {"close": 1}).select("symbol", "date", "close", "volume")


def win(n: int, by: str = "date") -> str:
    return f"over (partition by symbol order by {by} rows between {n - 1} preceding and current row)"


def full_sql(value: str, x: str, n: int) -> str:
    return f"case when count({x}) {win(n)} >= {n} then {value} end"


def mean_sql(x: str, n: int) -> str:
    return full_sql(f"cast(sum(cast({x} as decimal(12,2))) {win(n)} as double) / {n}", x, n)


SMA = ", ".join(f"{mean_sql('close', n)} as ma_{n}" for n in ind.SPANS)


@query("i1_sma", f"{B} select symbol, date, {SMA} from bars", " ".join(f"ma_{n}" for n in ind.SPANS))
def _(spark, d):
    return ind.sma(daily(spark, d)).select("symbol", "date", *(f"ma_{n}" for n in ind.SPANS))


BOLL = f"(select *, mid as boll_mid, mid + 2 * sd as boll_upper, mid - 2 * sd as boll_lower, ((mid + 2 * sd) - (mid - 2 * sd)) / mid * 100 as boll_width from (select *, {mean_sql('close', 20)} as mid, {full_sql('stddev_samp(close) ' + win(20), 'close', 20)} as sd from bars) _m)"


@query("i3_bollinger", f"{B} select symbol, date, boll_mid, boll_upper, boll_lower, boll_width from {BOLL} _b", "boll_mid boll_upper boll_lower boll_width")
def _(spark, d):
    return ind.bollinger(daily(spark, d)).select("symbol", "date", "boll_mid", "boll_upper", "boll_lower", "boll_width")


#: All recursions of a table `bars`, one step of each symbol at a time.
def recursion_cte(bars: str = "bars", tag: str = "", rsv: str | None = None) -> str:
    low, high = full_sql("min(low) " + win(9), "low", 9), full_sql("max(high) " + win(9), "high", 9)
    rsv = rsv or f"coalesce((close - {low}) / ({high} - {low} + 1e-9) * 100, 50e0)"
    return f"""
_f{tag} as materialized (select symbol, date, close, row_number() over (partition by symbol order by date) as i, {rsv} as rsv from {bars}),
_r{tag}(symbol, date, i, ema_12, ema_26, dea, kdj_k, kdj_d) as (
  select symbol, date, i, close, close, 0e0, 2e0/3*50e0 + 1e0/3*rsv, 2e0/3*50e0 + 1e0/3*(2e0/3*50e0 + 1e0/3*rsv) from _f{tag} where i = 1
  union all
  select symbol, date, i, a, b, (1 - 2e0/10)*dea + 2e0/10*(a - b), k, 2e0/3*kdj_d + 1e0/3*k
  from (select f.symbol, f.date, f.i, dea, kdj_d, (1 - 2e0/13)*ema_12 + 2e0/13*close as a, (1 - 2e0/27)*ema_26 + 2e0/27*close as b, 2e0/3*kdj_k + 1e0/3*rsv as k
        from _r{tag} r join _f{tag} f on f.symbol = r.symbol and f.i = r.i + 1) _x),
rec{tag} as materialized (select symbol, date, ema_12, ema_26, ema_12 - ema_26 as dif, dea, 2*((ema_12 - ema_26) - dea) as hist, kdj_k, kdj_d, 3*kdj_k - 2*kdj_d as kdj_j from _r{tag})"""


BR = f"with recursive bars as materialized ({DAILY}), {recursion_cte()}"


def _rec(columns: str):
    return lambda spark, d: ind.recursions(daily(spark, d)).select("symbol", "date", *columns.split())


for _name, _columns in (("i2_ema", "ema_12 ema_26"), ("i4_macd", "dif dea hist"), ("i5_kdj", "kdj_k kdj_d kdj_j")):
    query(_name, f"{BR} select symbol, date, {', '.join(_columns.split())} from rec", _columns)(_rec(_columns))

_DELTA = "(select *, coalesce(cast(close as decimal(12,2)) - lag(cast(close as decimal(12,2))) over (partition by symbol order by date), 0) as delta from bars)"


def rsi_sql(n: int) -> str:
    g, l = (full_sql(f"cast(sum(greatest({s}delta, 0)) {win(n)} as double) / {n}", "close", n) for s in ("", "-"))  # noqa: E741
    return f"100 - 100 / (1 + ({g}) / (({l}) + 1e-9))"


@query("i6_rsi", f"{B} select symbol, date, {', '.join(f'{rsi_sql(n)} as rsi_{n}' for n in (6, 12, 24))} from {_DELTA} _d", "rsi_6 rsi_12 rsi_24")
def _(spark, d):
    return ind.rsi(daily(spark, d)).select("symbol", "date", "rsi_6", "rsi_12", "rsi_24")


TR = "greatest(high - low, coalesce(abs(high - lag(close) over (partition by symbol order by date)), 0), coalesce(abs(low - lag(close) over (partition by symbol order by date)), 0))"
ATR = f"(select *, coalesce({mean_sql('tr', 14)}, tr) as atr from (select *, {TR} as tr from bars) _t)"


@query("i7_atr", f"{B} select symbol, date, tr, atr from {ATR} _a", "tr atr")
def _(spark, d):
    return ind.atr(daily(spark, d)).select("symbol", "date", "tr", "atr")


@query("i8_volume_ma", f"{B} select symbol, date, {full_sql('avg(volume) ' + win(5), 'volume', 5)} as vol_ma_5, {full_sql('avg(volume) ' + win(10), 'volume', 10)} as vol_ma_10 from bars", "vol_ma_5 vol_ma_10")
def _(spark, d):
    return ind.volume_ma(daily(spark, d)).select("symbol", "date", "vol_ma_5", "vol_ma_10")


_P5 = "over (partition by symbol order by date rows between 5 preceding and 1 preceding)"
VR = f"(select *, coalesce(volume / (case when count(volume) {_P5} >= 5 then avg(volume) {_P5} end + 1e-9), 1e0) as vol_ratio from bars)"


@query("i9_vol_ratio", f"{B} select symbol, date, vol_ratio from {VR} _v", "vol_ratio")
def _(spark, d):
    return ind.vol_ratio(daily(spark, d)).select("symbol", "date", "vol_ratio")


@query("i10_period_vol_ratio", f"{B} select symbol, date, round(volume / ({full_sql('avg(volume) ' + win(5), 'volume', 5)} + 1e-9), 2) as period_vol_ratio from bars")
def _(spark, d):
    return ind.period_vol_ratio(daily(spark, d)).select("symbol", "date", "period_vol_ratio")


def run_sql(condition: str, name: str, table: str) -> str:
    return f"(select * exclude (_h, _i), cast(sum(_h) over (partition by symbol, _i order by date rows unbounded preceding) as int) as {name} from (select *, case when {condition} then 1 else 0 end as _h, sum(case when {condition} then 0 else 1 end) over (partition by symbol order by date rows unbounded preceding) as _i from {table} _u) _v)"


RUNS = run_sql("close > before", "up_run", run_sql("close < before", "down_run", "(select *, lag(close) over (partition by symbol order by date) as before from bars)"))


@query("i11_runs", f"{B} select symbol, date, down_run, up_run from {RUNS} _r")
def _(spark, d):
    return ind.consecutive_runs(daily(spark, d)).select("symbol", "date", "down_run", "up_run")


@query("i12_heavy_run", f"{B} select symbol, date, least(r, 5) as heavy_run from {run_sql('vol_ratio > 1.5e0', 'r', VR)} _h")
def _(spark, d):
    return ind.heavy_volume_run(ind.vol_ratio(daily(spark, d))).select("symbol", "date", "heavy_run")


@query("oversold_touch", f"{BR}, f as (select symbol, date, close, kdj_j, boll_lower, vol_ratio from {BOLL} b join rec using (symbol, date) join (select symbol, date, vol_ratio from {VR} _v) v using (symbol, date)) select * from (select * from f qualify row_number() over (partition by symbol order by date desc) = 1) _l where close <= boll_lower * 1.02e0 and kdj_j < 30 order by kdj_j, symbol", "kdj_j boll_lower vol_ratio")
def oversold_touch(spark, d):
    """Symbols near their lower band while oversold, as of their last bar."""
    bars = ind.recursions(ind.vol_ratio(ind.bollinger(daily(spark, d))))
    last = src.latest(bars.select("symbol", "date", "close", "kdj_j", "boll_lower", "vol_ratio"))
    return last.where((F.col("close") <= F.col("boll_lower") * 1.02) & (F.col("kdj_j") < 30)).orderBy("kdj_j", "symbol")
