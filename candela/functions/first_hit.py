"""The first later row of a series whose value is at or below a level, by a search tree of block minima.

A node holds the minima of FAN nodes below it (or FAN values). A search looks for a hit behind its own place in its node,
goes up while there is none, and then down: log(length) joins on (series, node) of arrays of FAN values, however far away
the hit lies, and no row meets all of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.windows import KEY

FAN = 64


def _nodes(rows: DataFrame) -> DataFrame:
    """rows (symbol, i, value) -> (symbol, node, values by place); nulls where a place is missing."""
    found = rows.groupBy(KEY, F.floor(F.col("i") / FAN).alias("node")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") % FAN).cast("int").alias("k"), "value"))).alias("m"))
    return found.select(KEY, "node", F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.try_element_at("m", k)).alias("values"))


def first_hit(events: DataFrame, rows: DataFrame, length: int, name: str = "hit") -> DataFrame:
    """events (symbol, i, level, ...) with `name`: the smallest i of a row (symbol, i, value) beyond the event's own with value <= level.

    Null if there is none; null values and levels never hit. A series has one row a place, and `length` places at most.
    """
    levels = [_nodes(rows.select(KEY, "i", "value"))]
    while length > FAN:
        up = levels[-1].select(KEY, F.col("node").alias("i"), F.array_min("values").alias("value"))
        levels.append(_nodes(up))
        length = -(-length // FAN)
    # _p: where to look from, at the level in turn; _at: the level where a hit was met, then its place.
    out = events.withColumns({"_p": (F.col("i") + 1).cast("long"), "_at": F.lit(None).cast("int"), "_hit": F.lit(None).cast("long")})

    def inside(first: Column) -> Column:
        """Place of the first value from `first` on within the node that is low enough."""
        behind = F.slice("values", first + 1, FAN)
        found = F.array_position(F.transform(behind, lambda v: F.coalesce(v <= F.col("level"), F.lit(False))), True).cast("int")
        return F.when(found > 0, first + found - 1)

    def joined(left: DataFrame, nodes: DataFrame, node: Column) -> DataFrame:
        return left.withColumn("node", node).join(nodes, [KEY, "node"], "left")

    for k, nodes in enumerate(levels):
        open_ = F.col("_at").isNull()
        out = joined(out, nodes, F.when(open_, F.floor(F.col("_p") / FAN))).withColumn("_k", inside((F.col("_p") % FAN).cast("int")))
        met = open_ & F.col("_k").isNotNull()
        out = out.withColumns({
            "_hit": F.when(met, F.col("node") * FAN + F.col("_k")).otherwise(F.col("_hit")), "_at": F.when(met, F.lit(k)).otherwise(F.col("_at")),
            "_p": F.when(open_ & ~met, F.floor(F.col("_p") / FAN) + 1).otherwise(F.col("_p")),
        }).drop("node", "values", "_k")
    for k in range(len(levels) - 2, -1, -1):
        down = F.col("_at") == k + 1
        out = joined(out, levels[k], F.when(down, F.col("_hit"))).withColumn("_k", inside(F.lit(0)))
        out = out.withColumns({"_hit": F.when(down, F.col("node") * FAN + F.col("_k")).otherwise(F.col("_hit")), "_at": F.when(down, F.lit(k)).otherwise(F.col("_at"))}).drop("node", "values", "_k")
    return out.withColumn(name, F.col("_hit").cast("int")).drop("_p", "_at", "_hit")
