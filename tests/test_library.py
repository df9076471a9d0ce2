"""The market-bar library: vectors, properties and every query against its DuckDB SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from candela.functions.stats import normal_tail, wilson
from candela.operators import evaluation, indicators, levels, normalise, profile, regime, scoring, structure
from candela.plans import catalog
from candela.streaming.bars import merge_live_bar

TABLES = "region nation customer supplier part orders lineitem events".split()
NAN = float("nan")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, int | float):
        return str(v)
    return f"{float(v) + 0.0:.6f}"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"select {quoted} from ({catalog.ORACLE[name]}) q").fetchall())
    assert got == want


def bars(spark, closes, symbol=1, **more):
    rows = [(symbol, i, float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol int, n int, close double").withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("n"))).drop("n")
    base = {"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1000.0), "amount": F.col("close") * 1000}
    return df.withColumns(base | {k: F.lit(v) for k, v in more.items()})


def test_normal_tail(spark):
    xs = [i / 4 for i in range(-32, 33)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_tail(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - math.erfc(r.x / math.sqrt(2)) / 2) for r in got) < 1e-14
    one = spark.range(1).select(regime.exceedance_probability(F.lit(1.0), 1.0).alias("p"), regime.exceedance_probability(F.lit(0.0)).alias("none")).head()
    assert one.p == pytest.approx(0.15865525, abs=5e-8) and one.none is None


def test_wilson_of_nothing(spark):
    low, high = wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).head()) == (0.0, 1.0)


def test_score_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 19.9, 20, 40, 60, 80, 100)], "s double")
    assert [r[0] for r in df.select(regime.score_bin(F.col("s"))).collect()] == [0, 0, 1, 2, 3, 4, 4]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(regime.score_bin(F.lit(101.0))).collect()


def walked(path, stop, horizon, limit=10.0):
    """(price, hit) of a sale, day by day; (None, None) if the path ends first."""
    sound = lambda *prices: all(p == p and p > 0 for p in prices)
    ordered = due = False
    for k, (o, h, low, c) in enumerate(path):
        highs = [] if h is None else [h]
        if k and sound(o, low, c, path[k - 1][3], *highs):
            at_limit = c <= path[k - 1][3] * (1 - limit / 100 + 0.001)
            if not (at_limit and low == c and all(x == low for x in [*highs, *([o] if highs else [])])):
                if ordered or due:
                    return o, ordered
                if low <= stop:
                    return min(o, stop), True
                if k >= horizon:
                    return c, False
        ordered, due = ordered or low <= stop and not due, due or k >= horizon
    return None, None


def test_executable_exit_on_random_paths(spark):
    rng, rows = random.Random(17), []
    for _ in range(600):
        path, c, with_highs = [], 50.0, rng.random() < 0.7
        for _ in range(rng.randrange(1, 9)):
            o = round(c * rng.uniform(0.93, 1.05), 2)
            low, close = round(o * rng.uniform(0.93, 1), 2), round(o * rng.uniform(0.95, 1.05), 2)
            low = min(low, close)
            high = round(max(o, close) * rng.uniform(1, 1.03), 2)
            if (kind := rng.random()) < 0.15:  # locked at the lower limit all day
                o = high = low = close = round(c * 0.9, 2)
            elif kind < 0.22:
                o = rng.choice([NAN, 0.0])
            path.append((o, high if with_highs else None, low, close))
            c = close
        rows.append((path, round(rng.uniform(35, 52), 2), rng.randrange(6)))
    df = spark.createDataFrame(rows, "path array<struct<open double, high double, low double, close double>>, stop double, horizon int")
    got = df.select("*", evaluation.executable_exit(F.col("path"), F.col("stop"), F.col("horizon"), 10.0).alias("x")).collect()
    ends = {(r.x.price, r.x.hit) == walked([tuple(d) for d in r.path], r.stop, r.horizon) for r in got}
    assert ends == {True} and len({(r.x.price is None, r.x.hit) for r in got}) == 3


def test_neutral_composite_is_50(spark):
    rows = [tuple(w) for w in ((0.25, 0.25, 0.25, 0.25), (0.35, 0.2, 0.2, 0.25), (0.35, 0.2, 0.25, 0.2), (0.2, 0.25, 0.35, 0.2), (0.2, 0.3, 0.2, 0.3))]
    state = spark.createDataFrame([(i, *w, 50.0, 50.0, 50.0, 50.0) for i, w in enumerate(rows)], "symbol int, w_trend double, w_chips double, w_momentum double, w_position double, trend_score double, chip_score double, momentum_score double, position_score double")
    assert {r.bullish_score for r in scoring.composite_score(scoring.normalise_weights(state)).collect()} == {50.0}


def series(spark, n=320, symbol=1, seed=5):
    rng, c, out = random.Random(seed), 100.0, []
    for _ in range(n):
        c = round(c * math.exp(rng.gauss(0, 0.012)), 2)
        out.append(c)
    return bars(spark, out, symbol)


def test_no_look_ahead(spark):
    whole = series(spark)
    cut = whole.where(F.col("date") <= "2020-08-01")
    columns = ["date", "ma_20", "boll_upper", "rsi_6", "atr", "vol_ratio", "dif", "dea", "kdj_j", "heavy_run"]
    early = indicators.all_indicators(cut).select(columns).orderBy("date").collect()
    late = indicators.all_indicators(whole).where(F.col("date") <= "2020-08-01").select(columns).orderBy("date").collect()
    assert early == late and len(early) > 200


def test_slices_do_not_look_ahead(spark):
    df = series(spark)
    sliced = evaluation.asof_slices(df, step=20)
    last = {r.symbol % evaluation.SLICE: r for r in sliced.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("to")).collect()}
    days = [r.date for r in df.orderBy("date").collect()]
    assert sorted(last) == list(range(249, len(days) - 21, 20))
    assert all(r.n == 250 and r.to == days[t] for t, r in last.items())


def test_row_order_and_partitions_do_not_matter(spark):
    df = series(spark).unionByName(series(spark, symbol=2, seed=6))
    made = lambda x: sorted(map(str, profile.volume_profile(x).collect())) + sorted(map(str, structure.price_gaps(x).collect())) + sorted(map(str, indicators.recursions(x).select("symbol", "date", "hist").collect()))
    assert made(df) == made(df.orderBy(F.rand(3)).repartition(13))


@pytest.mark.parametrize("n", [1, 5, 9, 10, 15, 20, 30])
def test_short_series(spark, n):
    df = series(spark, n)
    assert indicators.all_indicators(df).count() == (n if n >= 10 else 0)
    assert structure.swing_points(df).count() >= 0 and structure.price_gaps(df).count() >= 0
    assert structure.fibonacci_wave(df).count() == (1 if n >= 20 else 0)
    assert structure.macd_divergence(indicators.recursions(indicators.atr(df))).count() == (1 if n >= 30 else 0)
    assert evaluation.asof_grid(df).count() == 0 and regime.regime_features(df).count() == 0


def test_flat_prices_and_no_volume(spark):
    flat = bars(spark, [10.0] * 60).withColumns({"high": F.col("close"), "low": F.col("close")})
    assert profile.volume_profile(flat).agg(F.sum("density")).head()[0] == pytest.approx(1)
    assert indicators.all_indicators(flat).where("kdj_j is null or rsi_6 is null").where("date > '2020-01-10'").count() == 0
    assert profile.volume_profile(flat.withColumn("volume", F.lit(0.0))).count() == 0


def test_empty_bars(spark):
    none = series(spark, 10).limit(0)
    assert indicators.all_indicators(none).count() == 0 and normalise.weekly(none).count() == 0 and profile.volume_profile(none).count() == 0


def test_week_label(spark):
    days = spark.sql("select date_add(date '2024-01-06', cast(id as int)) as d from range(7)")  # Saturday to Friday
    assert {str(r[0]) for r in days.select(normalise.week_of(F.col("d"))).collect()} == {"2024-01-12"}


def test_clusters_do_not_chain(spark):
    rows = [(1, 100.0 + 1.2 * k, 10, f"s{k}", "MA_CHANNEL", 200.0, "support") for k in range(6)]
    df = spark.createDataFrame(rows, "symbol int, price double, weight int, source string, category string, close double, side string")
    got = levels.cluster_levels(df).orderBy("price").collect()
    for c in {r.cluster for r in got}:
        prices = [r.price for r in got if r.cluster == c]
        assert max(prices) - min(prices) <= min(prices) * 0.03


def test_live_bar_rules(spark):
    history = bars(spark, [10.0, 11.0]).select("symbol", "date", "open", "high", "low", "close", "volume", "amount")
    snap = lambda day, o, h, low, c, v: spark.createDataFrame([(1, day, o, h, low, c, v, 5.0)], "symbol int, date string, open double, high double, low double, close double, volume double, amount double").withColumn("date", F.col("date").cast("date"))
    last = lambda s: merge_live_bar(history, s).orderBy(F.desc("date")).head()
    same = last(snap("2020-01-02", 11.0, 11.5, 9.0, 13.0, 0.0))
    assert (same.close, same.high, same.low, same.volume, same.merged) == (13.0, 13.0, 9.0, 1000.0, True)
    new = last(snap("2020-01-03", 11.0, 11.5, 10.5, 12.0, 7.0))
    assert (str(new.date), new.high, new.low, new.volume) == ("2020-01-03", 12.0, 10.5, 7.0)
    for s in (snap("2020-01-03", 11.0, 11.5, 10.5, 12.0, 0.0), snap("2020-01-03", 11.0, 11.5, 0.0, 12.0, 7.0), snap("2020-01-01", 11.0, 11.5, 9.0, 12.0, 7.0)):
        assert str(last(s).date) == "2020-01-02" and merge_live_bar(history, s).count() == 2
