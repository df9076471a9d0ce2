"""Ranks within a moving window, from a sorted list that each value enters once and leaves once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from candela.functions.windows import KEY, position

#: Rows of a symbol that meet in one task's array.
BLOCK = 1 << 16


def moving_ranks(df: DataFrame, columns: list[str], window: int, by: str = "date", block: int = BLOCK) -> DataFrame:
    """df with, for each column c, counts over the last `window` rows, the own one included: c_n (values), c_below (values
    under the own) and c_upto (values up to the own); the last two are null where the own value is null or NaN, which
    aren't counted.

    A symbol is cut into blocks of rows, each of which takes the window - 1 rows before it along, so that no array grows
    with the series.
    """
    place = F.col("_at")
    mine = F.floor(place / block)
    ahead = place % block >= block - (window - 1) if window - 1 < block else F.lit(True)
    reach = -(-(window - 1) // block)
    rows = df.withColumn("_at", position(by).cast("long"))
    rows = rows.withColumn("_block", F.explode(F.when(ahead, F.sequence(mine, mine + reach)).otherwise(F.array(mine))))
    schema = StructType(df.schema.fields)
    for c in columns:
        for kind in ("n", "below", "upto"):
            schema = schema.add(f"{c}_{kind}", LongType())

    def ranked(table):
        from bisect import bisect_left, bisect_right, insort

        import numpy as np
        import pyarrow as pa

        table = table.sort_by("_at")
        at, blocks = table["_at"].to_numpy(), table["_block"].to_numpy()
        own = at // block == blocks
        out = table.drop_columns(["_at", "_block"]).filter(pa.array(own))
        for c in columns:
            values = table[c].cast(pa.float64()).to_numpy()
            held, n, below, upto = [], *(np.zeros(len(values), np.int64) for _ in range(3))
            for i, x in enumerate(values.tolist()):
                if i >= window and values[i - window] == values[i - window]:
                    del held[bisect_left(held, values[i - window])]
                if x == x:
                    insort(held, x)
                    below[i], upto[i] = bisect_left(held, x), bisect_right(held, x)
                n[i] = len(held)
            missing = np.isnan(values)[own]
            out = out.append_column(f"{c}_n", pa.array(n[own]))
            out = out.append_column(f"{c}_below", pa.array(below[own], mask=missing))
            out = out.append_column(f"{c}_upto", pa.array(upto[own], mask=missing))
        return out

    return rows.groupBy(KEY, "_block").applyInArrow(ranked, schema)
