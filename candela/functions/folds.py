"""Linear recursions of one symbol, y = a y + b from row to row, as a blocked scan.

A block of rows is one affine map, and maps compose: each block's map is folded from its rows, the maps of blocks before it
are composed in steps of a block's length, and each block then follows its own rows from the value that arrives. No array
is longer than a block (or the series' length over BLOCK cubed), time is linear in the series, and all of it uses the one
partitioning by symbol.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

from candela.functions.windows import KEY, series

BLOCK = 256
#: Rows that a task of by_series() gathers, beside what is left of a series.
SERIES_ROWS = 65_536


class Step(NamedTuple):
    """A row's map: y becomes a y + b, or b alone where `cut` holds. Before the first cut y is null."""

    cut: Column
    a: Column
    b: Column


def ema_step(x: Column, span: int, by: str = "date") -> Step:
    """y = (1 - w) y + w x with w = 2 / (span + 1), from the first value; a null x gives null and starts anew after it."""
    w = 2.0 / (span + 1)
    new = F.lag(x).over(series(by)).isNull()
    return Step(new, F.lit(1 - w), F.when(new, x).otherwise(w * x))


def decay_step(x: Column, weight: float, start: float, by: str = "date") -> Step:
    """y = (1 - weight) y + weight x from `start` before the first row; null from a null x on."""
    rest = 1 - weight
    new = F.row_number().over(series(by)) == 1
    return Step(new, F.lit(rest), F.when(new, rest * start + weight * x).otherwise(weight * x))


def affine_scan(df: DataFrame, steps: dict[str, Step], by: str = "date") -> DataFrame:
    """df with a column for each recursion: its value after each row of the symbol, in the order of `by`.

    Rows that repeat a symbol and time follow one another in an undefined order. An empty table gives an empty one.
    """
    names, columns = list(steps), [c for c in df.columns if c not in steps]
    parts = [F.struct(s.cut.alias("cut"), s.a.cast("double").alias("a"), s.b.cast("double").alias("b")).alias(n) for n, s in steps.items()]
    placed = df.select(*columns, F.struct(*parts).alias("_scan_map"), (F.row_number().over(series(by)) - 1).alias("_scan_i"))
    row = F.struct("_scan_i", "_scan_map", F.struct(*[c for c in columns if c != KEY]).alias("row"))
    blocks = placed.groupBy(KEY, F.floor(F.col("_scan_i") / BLOCK).alias("_scan_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def each(f: Callable[[str], Column]) -> Column:
        return F.struct(*(f(n).alias(n) for n in names))

    def after(first: Column, then: Column) -> Column:
        """The map of `first` and `then` in a row."""
        def one(n: str) -> Column:
            l, r = first[n], then[n]
            return F.struct((l["cut"] | r["cut"]).alias("cut"), (l["a"] * r["a"]).alias("a"), F.when(r["cut"], r["b"]).otherwise(r["a"] * l["b"] + r["b"]).alias("b"))

        return each(one)

    # A fold takes its type from its start, so that b must be nullable there.
    zero = F.nullif(F.lit(0.0), F.lit(1.0))
    still = each(lambda n: F.struct(F.lit(False).alias("cut"), F.lit(1.0).alias("a"), zero.alias("b")))
    composed = lambda maps: F.aggregate(maps, still, after)
    out = blocks.withColumn("_total", composed(F.transform("_rows", lambda r: r["_scan_map"])))
    # Maps before a block: of the blocks in its run of BLOCK, of the runs in its run of BLOCK runs, and of those before.
    for level, span in enumerate((BLOCK, BLOCK * BLOCK, None)):
        keys = [KEY] if span is None else [KEY, F.floor(F.col("_scan_block") / span)]
        ahead = Window.partitionBy(*keys).orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_before{level}", composed(F.collect_list("_total").over(ahead)))
        if span:
            ends = F.col("_scan_block") % span == span - 1
            out = out.withColumn("_total", F.when(ends, after(F.col(f"_before{level}"), F.col("_total"))))
    arriving = reduce(after, (F.col(f"_before{level}") for level in (2, 1, 0)))
    out = out.select(KEY, "_rows", arriving.alias("_m")).select(KEY, "_rows", each(lambda n: F.when(F.col("_m")[n]["cut"], F.col("_m")[n]["b"])).alias("_now"))

    def follow(state: Column, r: Column) -> Column:
        value = lambda n: F.when(r["_scan_map"][n]["cut"], r["_scan_map"][n]["b"]).otherwise(r["_scan_map"][n]["a"] * state["now"][n] + r["_scan_map"][n]["b"])
        now = each(value)
        return F.struct(now.alias("now"), F.concat(state["all"], F.array(now)).alias("all"))

    none = F.array().cast(f"array<struct<{','.join(f'`{n}`:double' for n in names)}>>")
    states = F.aggregate("_rows", F.struct(F.col("_now").alias("now"), none.alias("all")), follow, lambda s: s["all"])
    rows = out.select(KEY, F.explode(F.arrays_zip("_rows", states.alias("_states"))).alias("_r"))
    kept = [F.col(KEY) if c == KEY else F.col("_r._rows.row")[c].alias(c) for c in columns]
    return rows.select(*kept, *(F.col("_r._states")[n].alias(n) for n in names))


def in_order(df: DataFrame, inputs: list[str], outputs: list[str], start: Callable[[], Callable], by: str | list[str] = "date", keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """df with double columns `outputs`: what a walk of the symbol gives for the inputs of each row, in the order of `by`.

    start: makes a symbol's walk, a function from the inputs of a row (None for null) to its outputs. A task reads its symbols
    in order, a batch at a time, and keeps one walk; rows that repeat a symbol and time follow in an undefined order. With
    more `keys` there is a walk for each of their values.
    """
    import pyarrow as pa

    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in outputs])
    # The window brings all rows of a symbol into one task; its column goes along so that it stays in the plan.
    order = [by] if isinstance(by, str) else by
    placed = df.withColumn("_in_order", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).sortWithinPartitions(*keys, *order)

    def scan(batches):
        symbol, walk = object(), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            found = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*columns)):
                if key != symbol:
                    symbol, walk = key, start()
                found.append(walk(*row))
            made = [pa.array(c, pa.float64(), from_pandas=False) for c in zip(*found)] or [pa.array([], pa.float64()) for _ in outputs]
            kept = [c for c in batch.schema.names if c != "_in_order"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + outputs)

    return placed.mapInArrow(scan, schema)


def by_series(df: DataFrame, outputs: dict[str, str], make: Callable, by: str = "date", last: int | None = None, some: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns `outputs` (names and types) that make() gives for whole series, many at a time; if given, of the
    last `last` rows of each series alone, or of rows with a value in one of the columns `some`.

    make: from an Arrow table of whole series, rows in the order of `by`, and the place of each one's first row to arrays. A
    task reads its symbols in one sort and holds SERIES_ROWS rows, or one series if that is longer.
    """
    import pyarrow as pa

    schema = StructType(df.schema.fields + [StructField(c, _parse_datatype_string(kind)) for c, kind in outputs.items()])
    placed = df.withColumn("_in_order", F.row_number().over(Window.partitionBy(KEY).orderBy(by))).sortWithinPartitions(KEY, by)

    def starts(table):
        import numpy as np

        key = table[KEY].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))

    def found(table, heads):
        import numpy as np

        out = table.drop_columns(["_in_order"])
        for c, x in zip(outputs, make(table, heads)):
            out = out.append_column(c, x)
        if last is not None:
            left = np.repeat(np.append(heads[1:], len(out)), np.diff(np.append(heads, len(out)))) - np.arange(len(out))
            out = out.filter(pa.array(left <= last))
        if some:
            out = out.filter(pa.array(np.logical_or.reduce([out[c].is_valid().to_numpy() for c in some])))
        return out.to_batches(max_chunksize=10_000)

    def scan(batches):
        parts, rows, enough = [], 0, SERIES_ROWS
        for batch in batches:
            parts, rows = [*parts, batch], rows + batch.num_rows
            if rows >= enough:
                table = pa.Table.from_batches(parts).combine_chunks()
                heads = starts(table)
                # The last series may go on in the next batch.
                if whole := int(heads[-1]):
                    yield from found(table.slice(0, whole), heads[:-1])
                parts, rows = table.slice(whole).to_batches(), len(table) - whole
                enough = max(SERIES_ROWS, 2 * rows)
        if rows:
            table = pa.Table.from_batches(parts).combine_chunks()
            yield from found(table, starts(table))

    return placed.mapInArrow(scan, schema)
