"""Bar tables from ticks, tables and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.windows import KEY, from_end


def bars_from_ticks(ticks: DataFrame, bucket: Column, order: str, name: str = "date") -> DataFrame:
    """Open, high, low, close, volume and amount of each symbol and bucket; ticks need price, volume and a unique order."""
    return ticks.groupBy(KEY, bucket.alias(name)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"), F.round(F.sum(F.col("volume") * F.col("price")), 2).alias("amount"),
    )


def scan_bars(bars: DataFrame, count: int = 250) -> DataFrame:
    """The last `count` bars of each symbol."""
    return bars.withColumn("_n", from_end()).where(F.col("_n") <= count).drop("_n")


def source_fallback(*sources: DataFrame) -> DataFrame:
    """Each symbol's whole series from the first source that has it; sources carry their own source and adjustment tags."""
    ranked = [s.withColumn("_at", F.lit(i)) for i, s in enumerate(sources)]
    all_rows = ranked[0]
    for s in ranked[1:]:
        all_rows = all_rows.unionByName(s)
    best = F.min("_at").over(Window.partitionBy(KEY))
    return all_rows.withColumn("_best", best).where(F.col("_at") == F.col("_best")).drop("_at", "_best")


def series_tags(bars: DataFrame) -> DataFrame:
    """One row a symbol: its source and adjustment, or 'unknown' where its rows disagree or one has none."""

    def tag(name: str) -> Column:
        same = (F.count_distinct(name) == 1) & (F.count(name) == F.count(F.lit(1)))
        return F.when(same, F.min(name)).otherwise("unknown").alias(name)

    return bars.groupBy(KEY).agg(tag("source"), tag("adjustment"), F.count(F.lit(1)).alias("bars"))


def with_instruments(df: DataFrame, instruments: DataFrame, fallback: DataFrame | None = None, industry: str = "main board") -> DataFrame:
    """df with name and industry of each symbol: from the dimension, else the fallback, else made from the symbol.

    The dimension has a row a symbol; Spark broadcasts it if its statistics allow that.
    """
    out = df.join(instruments.select(KEY, "name", "industry"), KEY, "left")
    if fallback is not None:
        out = out.join(fallback.select(KEY, F.col("name").alias("_name"), F.col("industry").alias("_industry")), KEY, "left")
        out = out.withColumns({"name": F.coalesce("name", "_name"), "industry": F.coalesce("industry", "_industry")}).drop("_name", "_industry")
    made = F.concat(F.lit("instrument "), F.col(KEY).cast("string"))
    return out.withColumns({"name": F.coalesce("name", made), "industry": F.coalesce("industry", F.lit(industry))})


def latest(df: DataFrame, by: str = "date") -> DataFrame:
    """The newest row of each symbol."""
    rest = [c for c in df.columns if c != KEY]
    return df.groupBy(KEY).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(KEY, "_r.*")


def dedupe_keep_last(df: DataFrame, arrival: str, keys: tuple[str, ...] = (KEY, "date")) -> DataFrame:
    """Of the rows of each key, the one that arrived last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def universe_snapshot(quotes: DataFrame, count: int = 240) -> DataFrame:
    """Quotes with a price, the `count` largest by amount (ties to the smaller symbol)."""
    return quotes.where(F.col("close") > 0).orderBy(F.desc("amount"), KEY).limit(count)


def funding_series(balances: DataFrame, arrival: str) -> DataFrame:
    """One balance a date, the last to arrive, newest first."""
    return dedupe_keep_last(balances, arrival, ("date",)).select("date", "balance").orderBy(F.desc("date"))


def market_breadth(bars: DataFrame, official: DataFrame | None = None, limit: float = 10.0) -> DataFrame:
    """Risers, fallers, flats and limit moves of each date's cross-section; official limit counts win where they exist."""
    c = F.col("change_pct")
    out = bars.groupBy("date").agg(
        F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"),
        F.count_if(c >= limit).alias("limit_up"), F.count_if(c <= -limit).alias("limit_down"),
    )
    if official is None:
        return out
    named = official.select("date", F.col("limit_up").alias("_up"), F.col("limit_down").alias("_down"))
    out = out.join(named, "date", "left")
    return out.withColumns({"limit_up": F.coalesce("_up", "limit_up"), "limit_down": F.coalesce("_down", "limit_down")}).drop("_up", "_down")


def index_snapshot(bars: DataFrame) -> DataFrame:
    """Last price and change of each index."""
    return latest(bars.select(KEY, "date", "close", "change_pct"))
