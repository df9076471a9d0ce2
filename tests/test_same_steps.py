"""Recursions take the steps of their SQL: equal to the last bit, so that values on a limit fall alike."""

import random

import duckdb
import pytest

from candela.operators import indicators as ind
from candela.plans.catalog_bars import recursion_cte


def test_recursions_to_the_last_bit(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(s, i, *(round(rng.uniform(90, 110), 2) for _ in range(3))) for s in (1, 2) for i in range(700)]
    df = spark.createDataFrame([(s, i, max(p), min(p), p[0]) for s, i, *p in rows], "symbol int, date int, high double, low double, close double")
    con = duckdb.connect()
    con.sql("create table bars (symbol int, date int, high double, low double, close double)")
    con.executemany("insert into bars values (?, ?, ?, ?, ?)", [tuple(r) for r in df.collect()])
    columns = ["ema_12", "ema_26", "dif", "dea", "hist", "kdj_k", "kdj_d", "kdj_j"]
    want = con.sql(f"with recursive {recursion_cte()} select symbol, date, {', '.join(columns)} from rec order by 1, 2").fetchall()
    got = ind.recursions(df.repartition(5)).select("symbol", "date", *columns).orderBy("symbol", "date").collect()
    assert [tuple(r) for r in got] == want


def test_recursions_of_missing_closes(spark):
    closes = [None, 10.0, 12.0, None, 11.0, 11.0]
    df = spark.createDataFrame([(None, i, 12.0, 9.0, c) for i, c in enumerate(closes)], "symbol int, date int, high double, low double, close double")
    got = ind.recursions(df).orderBy("date").collect()
    assert [r.ema_12 for r in got] == [None, 10.0, pytest.approx(10 + 2 * 2 / 13), None, 11.0, 11.0]
    assert [r.dea is None for r in got] == [c is None for c in closes] and got[0].kdj_k == pytest.approx(50.0)
    assert ind.recursions(df.limit(0)).count() == 0
