"""What one pass gives of as-of points, against the operators on copied histories; nothing is exchanged for it but the ticks."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from candela.operators import asof, causal, evaluation
from candela.operators import levels as lev
from candela.operators import structure as st
from candela.plans import fixtures as fx
from tests.test_causal import COLUMNS, walk
from tests.test_walks import unread

POINTS = causal.Points(warmup=50, step=7, longest=20)


@pytest.fixture(scope="module")
def odd(spark):
    """Series with missing prices, ties, and prices of many digits."""
    rng, rows = random.Random(5), []
    for symbol, n in ((1, 200), (2, 160), (3, 71), (4, 72), (5, 9)):
        for r in walk(symbol, n, symbol):
            r = list(r)
            for c in (3, 4, 5):
                if symbol == 1 and rng.random() < 0.06:
                    r[c] = None
                if symbol == 2:
                    r[c] = float(round(r[c] / 4) * 4) if rng.random() < 0.8 else r[c] + 1 / 3
            rows.append(tuple(r))
    return spark.createDataFrame(rows, COLUMNS).persist()


@pytest.fixture(scope="module")
def known(odd):
    later = odd.withColumns({"trades": F.lit(True), "next_open": F.lit(None).cast("double")})
    return asof.known_rows(later, POINTS, 3).withColumn("symbol", F.col("point")).persist()


@pytest.fixture(scope="module")
def slices(odd):
    return evaluation.asof_slices(odd, None, POINTS.warmup, POINTS.step, POINTS.longest).persist()


def rows(df, *columns):
    return sorted(map(repr, (tuple(repr(x) for x in r) for r in df.select(*columns).collect())))


def test_gaps(known, slices):
    gap = known.select("symbol", F.posexplode("_gaps").alias("nth", "g")).select("symbol", (F.col("nth") + 1).alias("nth"), F.when(F.col("g.up"), "UP_GAP").otherwise("DOWN_GAP").alias("kind"), "g.date", F.expr("floor(g.bottom*100+0.5)/100").alias("bottom"), F.expr("floor(g.top*100+0.5)/100").alias("top"))
    columns = ("symbol", "nth", "kind", "date", "bottom", "top")
    want = rows(st.price_gaps(slices), *columns)
    assert rows(gap, *columns) == want and len(want) > 60


def test_waves(known, slices):
    columns = ("symbol", "wave_high", "wave_low", "is_uptrend", "levels")
    got = st.wave_levels(known.select("symbol", (F.col("t") + 1).alias("n"), "near", "all"))
    want = rows(st.fibonacci_wave(slices), *columns)
    assert rows(got, *columns) == want and len(want) > 30


def test_weeks(known, odd):
    columns = ("symbol", *(f"ma_{n}" for n in (5, 10, 20, 30)), "boll_upper", "boll_lower")
    spread = F.col("_week_spread")
    got = known.where("_week_there").select("symbol", *(F.col(f"week_ma_{n}").alias(f"ma_{n}") for n in (5, 10, 20, 30)), (F.col("week_ma_20") + spread).alias("boll_upper"), (F.col("week_ma_20") - spread).alias("boll_lower"))
    # Two exact sums of ten digits, one of which keeps nine.
    six = lambda df: rows(df.withColumns({c: F.round(c, 6) for c in columns[1:]}), *columns)
    want = six(causal.weekly_part(odd, POINTS))
    assert six(got) == want and len(want) > 30
    whole = "symbol < 2000000 or symbol >= 3000000"  # prices of two digits
    assert rows(got.where(whole), *columns) == rows(causal.weekly_part(odd, POINTS).where(whole), *columns)


def test_days_after(known, odd):
    from candela.operators import exits

    days = exits.forward_days(odd, 10.0, 2).withColumn("t", F.row_number().over(evaluation.series()) - 1)
    want = days.select((F.col("symbol") * evaluation.SLICE + F.col("t")).alias("symbol"), F.transform("days", lambda d: F.struct(d["low"], d["open"], d["close"])).alias("days"))
    got = known.select("symbol", F.transform("days", lambda d: F.struct(d["low"], d["open"], d["close"])).alias("days"))
    assert rows(got.join(want.select("symbol"), "symbol", "anti"), "symbol") == [] and rows(got, "symbol", "days") == rows(want.join(got.select("symbol"), "symbol"), "symbol", "days")


def test_win_rates_are_those_of_the_patterns(spark):
    bars = spark.createDataFrame([r for s, n in ((1, 420), (2, 330), (3, 500)) for r in walk(s, n, s)], COLUMNS).persist()
    points = causal.Points(step=17)
    state, _ = causal.asof_state(bars, points)
    want = causal.asof_patterns(bars, state, points).select(F.col("symbol").alias("k"), "win_10")
    got = causal.point_in_time(bars, 10.0, points).select((F.col("symbol") * evaluation.SLICE + F.col("t")).alias("k"), "win_10")
    assert rows(got, "k", "win_10") == rows(want, "k", "win_10") and want.where("win_10 is not null").count() > 3


def test_bands_of_rows_are_those_of_candidates(spark):
    rng = random.Random(2)
    data = [(k, rng.choice(["support", "resistance"]), rng.choice([round(rng.uniform(90, 110), 1), math.nan]) if k == 3 else round(rng.uniform(90, 110), 1), f"s{rng.randrange(9)}", rng.randrange(1, 40), rng.choice("ab")) for k in range(12) for _ in range(25 if k != 5 else 1)]
    sided = spark.createDataFrame(data, "symbol long, side string, price double, source string, weight int, category string")
    want = lev.nearest_bands(sided)
    listed = sided.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("side", "price", "source", "weight", "category"))).alias("c"))
    none = spark.range(20, 21).select(F.col("id").alias("symbol"), F.array().cast(listed.schema["c"].dataType).alias("c"))
    got = lev.row_bands(listed.unionByName(none), "c")
    assert got.count() == 13 and got.where("size(bands) = 0").count() == 1
    columns = want.columns
    assert rows(got.select("symbol", F.explode("bands").alias("b")).select("symbol", "b.*"), *columns) == rows(want, *columns)


def test_points_exchange_nothing_but_the_ticks(spark, sf, tmp_path):
    sf = unread(sf, tmp_path)
    plan = causal.point_in_time(fx.daily_bars(spark, sf), 1.5, index=fx.index_daily(spark, sf, 0).select("date", "close"))._jdf.queryExecution().executedPlan().toString()
    alone = causal.point_in_time(fx.daily_bars(spark, sf), 1.5)._jdf.queryExecution().executedPlan().toString()
    assert alone.count("Exchange") == 1 and "SortMergeJoin" not in plan


def test_daily_correlations_deal_rows_once(spark):
    """Points are dealt by date before there is a row for each score, and not again for the ranks of each value."""
    data = [(f"2020-01-{1 + k % 5:02d}", float(k * 7 % 13), float(k % 11), float(k * 3 % 5)) for k in range(120)]
    df = spark.createDataFrame(data, "date string, ret_10 double, a double, b double")
    plan = evaluation.rank_ic(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(date" in plan and "hashpartitioning(score#" in plan and not re.search(r"hashpartitioning\(score#\d+, date#|hashpartitioning\(date#\d+, score#|hashpartitioning\(score#\d+, date#\d+, [xy]#", plan.replace("partial", ""))
    got = {r.score: (r.n, r.days) for r in evaluation.rank_ic(df, ["a", "b"]).collect()}
    assert got == {"a": (120, 5), "b": (120, 0)}  # all of a day have one b
