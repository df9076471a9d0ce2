"""Shares of a profile that meet a limit exactly: decided by exact sums, in the query and in its SQL alike."""

import math

import duckdb
import numpy as np

from candela.operators import profile as prof
from candela.plans.catalog_structure import SUMMARY

PARTS = [100, 270, 290, 190, 150]


def test_a_share_on_the_limit_counts(spark):
    # The fourth reaches 0.85 exactly; added as doubles it stays below.
    assert sum(PARTS) == 1000 and sum(PARTS[:4]) == 850 and np.cumsum([p / 1000 for p in PARTS])[3] < 0.85
    data = [(1, b, 10.0 + b, p / 1000, 12.0) for b, p in enumerate(PARTS)]
    df = spark.createDataFrame(data, "symbol long, bin int, centre double, density double, last_close double")
    got = prof.concentration(df).select("low_70", "high_70", "low_90", "high_90").head()
    con = duckdb.connect()
    con.execute("create table profile (symbol bigint, bin int, centre double, density double, last_close double)")
    con.executemany("insert into profile values (?, ?, ?, ?, ?)", data)
    assert tuple(got) == con.execute(f"with {SUMMARY} select low_70, high_70, low_90, high_90 from conc").fetchone() == (11.0, 13.0, 10.0, 14.0)
    assert prof.profit_ratio(df).head().profit_ratio == con.execute(f"with {SUMMARY} select profit_ratio from profit").fetchone()[0] == 66.0


def test_a_share_on_the_limit_counts_at_points(spark):
    """The same of blocks of a series: flat bars, each a bin of its own."""
    rows = [(1, t, 1 if t == len(PARTS) - 1 else None, True, 1000 * t, 1000 * t, 4000 * t, float(t), 0.01, float(t), float(p)) for t, p in enumerate(PARTS)]
    schema = "symbol long, t long, point long, sound boolean, m0 long, m1 long, middle long, mid double, width double, close double, weight double"
    marked = spark.createDataFrame(rows, schema)
    got, want = prof.moving_profile_state(marked), prof.profile_state(prof.moving_profile(marked))
    columns = sorted(want.columns)
    assert got.select(columns).collect() == want.select(columns).collect()
    cells = prof.moving_profile(marked).orderBy("bin").collect()
    assert [round(c.density * 1000) for c in cells] == PARTS
    assert got.select("high_70").head()[0] == math.floor(cells[3].centre * 100 + 0.5) / 100
