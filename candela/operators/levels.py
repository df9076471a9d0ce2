"""Support and resistance: weighted candidate prices, clustered, scored and ranked on each side of the close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from candela.functions.folds import in_order
from candela.functions.windows import KEY, rounded
from candela.sources.bars import latest

#: Weights of the candidates.
DAILY_WEIGHTS = {"ma_5": 8, "ma_10": 12, "ma_20": 20, "ma_30": 22, "ma_60": 28, "ma_120": 25, "ma_250": 30, "boll_upper": 18, "boll_lower": 18}
WEEKLY_WEIGHTS = {"ma_5": 18, "ma_10": 20, "ma_20": 30, "ma_30": 25, "ma_60": 32, "ma_120": 30, "ma_250": 32, "boll_upper": 22, "boll_lower": 22}
HOURLY_WEIGHTS = {"ma_20": 14, "ma_60": 20, "ma_120": 22, "boll_upper": 14, "boll_lower": 14}
POC, SECOND_PEAK, RANGE_EDGE, SWING, GAP, RETRACEMENT = 35, 20, 18, 24, 26, 22
STARS = ((75, 5), (55, 4), (38, 3), (22, 2))
TOLERANCE, KEPT = 0.015, 5


def _named(price: Column, weight: int, source: Column | str, category: str) -> Column:
    return F.struct(price.cast("double").alias("price"), F.lit(weight).alias("weight"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(category).alias("category"))


def _melted(rows: DataFrame, items: list[Column]) -> DataFrame:
    return rows.select(KEY, F.explode(F.array(*items)).alias("c")).select(KEY, "c.*")


def _from_row(last: DataFrame, weights: dict[str, int], prefix: str, category: str) -> DataFrame:
    return _melted(last, [_named(F.col(c), w, f"{prefix}_{c}", category) for c, w in weights.items()])


def level_candidates(daily: DataFrame, weekly: DataFrame | None, hourly: DataFrame | None, summary: DataFrame, peaks: DataFrame | None, swings: DataFrame, gaps: DataFrame, waves: DataFrame, single: bool = False) -> DataFrame:
    """Rows (symbol, price, weight, source, category) of all weighted prices above 0.

    daily, weekly, hourly: indicator frames, whose last rows count; single: daily and weekly have one row a symbol. summary and peaks: of the volume profile; without peaks
    those that profile_state() puts into the summary.
    """
    parts = [_from_row(daily if single else latest(daily), DAILY_WEIGHTS, "day", "MA_CHANNEL")]
    if weekly is not None:
        parts.append(_from_row(weekly if single else latest(weekly), WEEKLY_WEIGHTS, "week", "WEEKLY_MA"))
    if hourly is not None:
        parts.append(_from_row(latest(hourly), HOURLY_WEIGHTS, "hour", "INTRADAY_60M"))
    parts.append(_melted(summary, [_named(F.col("poc"), POC, "poc", "CHIPS"), _named(F.col("low_70"), RANGE_EDGE, "range_low", "CHIPS"), _named(F.col("high_70"), RANGE_EDGE, "range_high", "CHIPS")]))
    if peaks is None:
        centres = summary.select(KEY, "poc", F.explode("peaks").alias("_p")).select(KEY, "poc", rounded(F.col("_p.centre"), 2).alias("p"))
    else:
        centres = peaks.select(KEY, rounded(F.col("centre"), 2).alias("p")).join(summary.select(KEY, "poc"), KEY)
    second = centres.where(F.abs(F.col("p") - F.col("poc")) / F.col("poc") > 0.03)
    parts.append(_melted(second, [_named(F.col("p"), SECOND_PEAK, F.concat(F.lit("peak_"), F.col("p").cast("decimal(12,2)").cast("string")), "CHIPS")]))
    parts.append(_melted(swings, [_named(F.col("price"), SWING, F.concat(F.lit("swing_"), "kind", F.lit("_"), F.col("date").cast("string")), "STRUCTURE")]))
    edge = F.when(F.col("kind") == "UP_GAP", F.col("bottom")).otherwise(F.col("top"))
    parts.append(_melted(gaps, [_named(edge, GAP, F.concat("kind", F.lit("_"), F.col("date").cast("string")), "GAP")]))
    fib = waves.select(KEY, F.explode("levels").alias("l")).where(F.col("l.ratio").isin(0.382, 0.5, 0.618))
    parts.append(_melted(fib, [_named(F.col("l.price"), RETRACEMENT, F.concat(F.lit("fib_"), F.col("l.ratio").cast("string")), "FIBONACCI")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("price") > 0)


def split_sides(candidates: DataFrame, prices: DataFrame) -> DataFrame:
    """candidates with side (support or resistance) against each symbol's close; those within 0.05 % of it are dropped."""
    out = candidates.join(prices.select(KEY, "close"), KEY)
    side = F.when(F.col("price") <= F.col("close") * 0.9995, "support").when(F.col("price") >= F.col("close") * 1.0005, "resistance")
    return out.withColumn("side", side).where("side is not null")


def _clusters(tolerance: float):
    """The walk of one side of a symbol: from prices in ascending order to the number of their cluster."""

    def start():
        cluster, first, total, n = -1, 0.0, 0.0, 0

        def step(p):
            nonlocal cluster, first, total, n
            centre = total / (n or 1)
            # Prices that are NaN come last and are one cluster.
            if n and (abs(p - centre) <= centre * tolerance and abs(p - first) <= first * tolerance * 2 or p != p and first != first):
                total, n = total + p, n + 1
            else:
                cluster, first, total, n = cluster + 1, p, 0.0 + p, 1
            return (cluster,)

        return step

    return start


def cluster_levels(sided: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """sided with cluster: prices in ascending order join the open cluster while close to its mean and to its first price.

    The candidates of a side are walked row by row, in one sort of all of them.
    """
    item = ["price", "source", "weight", "category", "close"]
    walked = in_order(sided.select(KEY, "side", *item), ["price"], ["cluster"], _clusters(tolerance), item, (KEY, "side"))
    return walked.select(KEY, "side", F.col("cluster").cast("int").alias("cluster"), *item)


def score_bands(clustered: DataFrame) -> DataFrame:
    """One row a cluster: weighted centre, range, score, stars, its sources in price order and its number of items."""
    total = F.sum("weight")
    score = (total + (F.size(F.collect_set("category")) - 1) * 15).cast("int")
    sources = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("price", "source"))), lambda s: s["source"]))
    stars = F.lit(1)
    for least, n in reversed(STARS):
        stars = F.when(F.col("score") >= least, n).otherwise(stars)
    out = clustered.groupBy(KEY, "side", "cluster").agg(
        rounded(F.sum(F.col("price") * F.col("weight")) / (total + 1e-9), 2).alias("centre"), rounded(F.min("price"), 2).alias("low"), rounded(F.max("price"), 2).alias("high"),
        score.alias("score"), sources.alias("sources"), F.count(F.lit(1)).alias("items"),
    )
    return out.withColumn("stars", stars)


def rank_bands(bands: DataFrame) -> DataFrame:
    """The five bands nearest the close on each side, labelled S1..S5 and R1..R5 outwards."""
    support = F.col("side") == "support"
    outwards = F.when(support, -F.col("centre")).otherwise(F.col("centre"))
    out = bands.withColumn("nth", F.row_number().over(Window.partitionBy(KEY, "side").orderBy(outwards, "cluster"))).where(F.col("nth") <= KEPT)
    return out.withColumn("label", F.concat(F.when(support, "S").otherwise("R"), F.col("nth").cast("string"))).drop("cluster")


def nearest_bands(sided: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """rank_bands(score_bands(cluster_levels(sided))) in one exchange and one sort: clusters, their bands and the ranks of both
    sides are taken where a symbol's candidates lie. A batch's sides are walked together, a candidate of each at a time.
    """
    sided = sided.select(KEY, "side", "price", "source", "weight", "category")
    order = ["side", "price", "source", "weight", "category"]
    placed = sided.withColumn("_nth", F.row_number().over(Window.partitionBy(KEY).orderBy(*order))).sortWithinPartitions(KEY, *order)
    kind = sided.schema[KEY].dataType.simpleString()
    schema = f"{KEY} {kind}, side string, centre double, low double, high double, score int, sources array<string>, items long, stars int, nth int, label string"

    def banded(batches):
        import pyarrow as pa

        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            key = table[KEY].to_numpy()
            # The last symbol may go on in the next batch.
            whole = int((key != key[-1]).sum()) if len(key) else 0
            left = table.slice(whole)
            if whole:
                yield from _bands(table.slice(0, whole), tolerance).to_batches()
        if left is not None and left.num_rows:
            yield from _bands(left, tolerance).to_batches()

    return placed.mapInArrow(banded, schema)


_BAND = {"side": "string", "centre": "double", "low": "double", "high": "double", "score": "int", "sources": "array<string>", "items": "bigint", "stars": "int", "nth": "int", "label": "string"}


def row_bands(rows: DataFrame, column: str, tolerance: float = TOLERANCE) -> DataFrame:
    """rows with bands, an array of what nearest_bands() gives, in place of `column`, the candidates of each row: an array of (side,
    price, source, weight, category) in that order. Nothing is exchanged."""
    item = f"array<struct<{','.join(f'{c}:{kind}' for c, kind in _BAND.items())}>>"
    left = [f for f in rows.schema.fields if f.name != column]
    schema = StructType([*left, StructField("bands", _parse_datatype_string(item))])

    def banded(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(column)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            columns = {c: flat.field(c) for c in ("side", "price", "source", "weight", "category")}
            ends = np.zeros(len(lists) + 1, np.int32)
            if len(of):
                found = _bands(pa.table({KEY: of} | columns), tolerance)
                np.cumsum(np.bincount(found[KEY].to_numpy(), minlength=len(lists)), out=ends[1:])
                values = [found[c].combine_chunks() for c in _BAND]
            else:
                values = [pa.array([], f.type) for f in to_arrow_type(schema["bands"].dataType).value_type]
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, list(_BAND)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in left), bands], names=[*(f.name for f in left), "bands"])

    return rows.mapInArrow(banded, schema)


def _bands(rows, tolerance: float):
    """Arrow table of the ranked bands of whole symbols, whose candidates come in order."""
    import numpy as np
    import pyarrow as pa

    table = rows.combine_chunks()
    codes = lambda c: table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    heads = lambda *arrays: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])]))
    key, side, price, weight = table[KEY].to_numpy(), codes("side"), table["price"].to_numpy(), table["weight"].to_numpy().astype(np.int64)
    start = heads(key, side)
    size = np.diff(np.append(start, len(key)))
    start = start[np.argsort(-size, kind="stable")]
    size = -np.sort(-size)
    cluster, first, total, n = np.full(len(start), -1), np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start), np.int64)
    of = np.zeros(len(key), np.int64)
    for i in range(size[0]):
        some = slice(0, np.searchsorted(-size, -i))  # sides with more than i candidates
        p, f, t = price[start[some] + i], first[some], total[some]
        centre = t / np.maximum(n[some], 1)
        with np.errstate(invalid="ignore"):
            close = (np.abs(p - centre) <= centre * tolerance) & (np.abs(p - f) <= f * tolerance * 2)
        # Prices that are NaN come last and are one cluster.
        joins = (n[some] > 0) & (close | np.isnan(p) & np.isnan(f))
        cluster[some] += ~joins
        first[some], total[some], n[some] = np.where(joins, f, p), np.where(joins, t, 0.0) + p, np.where(joins, n[some], 0) + 1
        of[start[some] + i] = cluster[some]

    at = heads(key, side, of)
    items = np.diff(np.append(at, len(key)))
    band = np.repeat(np.arange(len(at)), items)
    weights = np.add.reduceat(weight, at)

    def firsts(code):
        """Places of the first row of each value in each band."""
        return np.sort(np.unique(band * (int(code.max()) + 1) + code, return_index=True)[1])

    known = firsts(codes("category"))
    kinds = np.bincount(band[known[table["category"].is_valid().to_numpy()[known]]], minlength=len(at))
    score = weights + (kinds - 1) * 15
    stars = np.select([score >= least for least, _ in STARS], [k for _, k in STARS], 1)
    # As in rounded(), whose floor is a long.
    two = lambda x: np.clip(np.nan_to_num(np.floor(x * 100.0 + 0.5), nan=0.0), -(2.0**63), 2.0**63) / 100.0
    with np.errstate(over="ignore"):
        centre = two(np.add.reduceat(price * weight, at) / (weights + 1e-9))
    support = table["side"].take(pa.array(at)).to_numpy() == "support"
    side_of = np.cumsum(np.concatenate([[False], (key[at][1:] != key[at][:-1]) | (side[at][1:] != side[at][:-1])]))
    ranked = np.lexsort((of[at], np.where(support, -centre, centre), side_of))
    begins = np.flatnonzero(np.concatenate([[True], side_of[1:] != side_of[:-1]]))
    nth = np.arange(len(at)) - begins[side_of] + 1
    kept, nth = ranked[nth <= KEPT], nth[nth <= KEPT]
    named = firsts(codes("source"))
    ends = np.concatenate([[0], np.cumsum(np.bincount(band[named], minlength=len(at)))]).astype(np.int32)
    sources = pa.ListArray.from_arrays(pa.array(ends), table["source"].combine_chunks().take(pa.array(named))).take(pa.array(kept))
    labels = np.char.add(np.where(support[kept], "S", "R"), nth.astype(str))
    lead = at[kept]
    return pa.table({
        KEY: table[KEY].take(pa.array(lead)), "side": table["side"].take(pa.array(lead)), "centre": centre[kept], "low": two(price[lead]), "high": two(price[lead + items[kept] - 1]),
        "score": score[kept].astype(np.int32), "sources": sources, "items": items[kept], "stars": stars[kept].astype(np.int32), "nth": nth.astype(np.int32), "label": pa.array(labels.tolist(), pa.string()),
    })


def levels(candidates: DataFrame, prices: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranked bands of all symbols."""
    return nearest_bands(split_sides(candidates, prices), tolerance)
