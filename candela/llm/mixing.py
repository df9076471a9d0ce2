"""Mixing sources to target weights by iterative proportional fitting.

The token mass of each (source, language, topic) cell is raked to the three target marginals, one after the other,
until it fits. A cell's raked mass over its natural mass is the weight of its documents; one scale, found exactly from
the sorted weights, turns weights into inclusion probabilities that are 1 at most and whose expected tokens meet the
budget. A document is drawn if a uniform number made from its id is below its probability, so runs agree.

Only cells reach the driver: at most one for each combination of categories, MOST_CELLS in all, checked before.
Documents never shuffle: the cell table is broadcast under the same bound.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CELLS, SWEEPS = 200_000, 60
#: Distance of a fitted share from its target that calls for a warning.
MISFIT = 1e-3
#: Targets of the query: natural shares to this power (which lifts small categories), and the part of all tokens to draw.
TEMPER, BUDGET = 0.7, 0.8
DIMS = ("source", "lang", "topic")
Cell = tuple[str, str, str]
Targets = dict[str, dict[str, float]]


def tempered(mass: dict[Cell, float], power: float = TEMPER) -> Targets:
    """Target shares of each category: its natural share to a power, made to sum to 1."""
    out: Targets = {}
    for k, dim in enumerate(DIMS):
        sums: dict[str, float] = defaultdict(float)
        for cell, m in mass.items():
            sums[cell[k]] += m
        total = sum(sums.values())
        raised = {c: (s / total) ** power for c, s in sums.items()}
        out[dim] = {c: r / sum(raised.values()) for c, r in raised.items()}
    return out


def rake(mass: dict[Cell, float], targets: Targets, sweeps: int = SWEEPS) -> dict[Cell, float]:
    """Cell masses fitted to the target shares of each dimension in turn; categories without a target get none."""
    total, w = sum(mass.values()), dict(mass)
    for _ in range(sweeps):
        for k, dim in enumerate(DIMS):
            sums: dict[str, float] = defaultdict(float)
            for cell, m in w.items():
                sums[cell[k]] += m
            w = {cell: m * targets[dim].get(cell[k], 0.0) * total / sums[cell[k]] if sums[cell[k]] else 0.0 for cell, m in w.items()}
    return w


def misfit(fitted: dict[Cell, float], targets: Targets) -> float:
    """Largest distance between a category's fitted share and its target, over all dimensions."""
    total, worst = sum(fitted.values()) or 1.0, 0.0
    for k, dim in enumerate(DIMS):
        sums: dict[str, float] = defaultdict(float)
        for cell, m in fitted.items():
            sums[cell[k]] += m / total
        worst = max([worst, *(abs(sums.get(c, 0.0) - t) for c, t in targets[dim].items())])
    return worst


def calibrate(mass: dict[Cell, float], raked: dict[Cell, float], budget: float) -> dict[Cell, tuple[float, float]]:
    """(weight, probability) of each cell: min(1, scale * weight) with sum(mass * probability) = budget."""
    weight = {c: raked[c] / m for c, m in mass.items()}
    order = sorted(weight, key=lambda c: (-weight[c], c))
    left, rest = budget, sum(mass[c] * weight[c] for c in order)
    scale = float("inf")
    for c in order:
        if rest <= 0 or left <= 0:
            break
        if (scale := left / rest) * weight[c] <= 1:
            break
        left, rest = left - mass[c], rest - mass[c] * weight[c]
    return {c: (x, min(1.0, scale * x) if x else 0.0) for c, x in weight.items()}


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(df: DataFrame, tokens: Column, source: Column, lang: Column, topic: Column, id_col: str = "doc_id", targets: Targets | Callable[[dict], Targets] = tempered, budget: float = BUDGET) -> DataFrame:
    """One row per row of df: _row (struct of its columns), topic, tokens, weight, probability, sampled.

    targets: shares for each dimension, or a function of the cell masses that gives them. budget: part of all tokens.
    Null categories count as empty ones; tokens are 1 at least. Rows that repeat an id are drawn together. An empty
    table gives an empty result. Targets that contradict each other on the cells there are give the last sweep's weights and
    a warning.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    row = F.struct(*(df[c].alias(n) for c, n in zip(df.columns, names)))
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(f"_{d}") for c, d in zip((source, lang, topic), DIMS)]
    base = df.select(row.alias("_row"), df[id_col].alias("_id"), *keys, F.greatest(tokens.cast("long"), F.lit(1).cast("long")).alias("tokens"))
    cells = base.groupBy(*(f"_{d}" for d in DIMS)).agg(F.sum("tokens").cast("double").alias("mass")).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: merge rare categories first")
    mass = {tuple(r[:3]): r["mass"] for r in sorted(cells)}
    wanted = targets(mass) if callable(targets) else targets
    raked = rake(mass, wanted)
    if mass and (off := misfit(raked, wanted)) > MISFIT:
        warnings.warn(f"target shares that these cells can't meet: one is off by {off:.3f}", stacklevel=2)
    got = calibrate(mass, raked, budget * sum(mass.values()))
    spark = df.sparkSession
    table = spark.createDataFrame([(*c, *x) for c, x in got.items()], "_source string, _lang string, _topic string, weight double, probability double")
    out = base.join(F.broadcast(table), [f"_{d}" for d in DIMS], "left").withColumn("sampled", uniform(F.col("_id")) < F.col("probability"))
    return out.select("_row", F.col("_topic").alias("topic"), "tokens", "weight", "probability", "sampled")


def unpack(mixed: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"_row._c{i}").alias(c) for i, c in enumerate(columns)]


def _letter(c: str) -> str:
    return f"(length(text) - length(replace(text, '{c}', '')))"


#: `documents` has no topic, so the query takes a stand-in from the whole text: which of four letters it has most of.
TOPIC = "case when text is null then '' " + " ".join(f"when {' and '.join(f'{_letter(c)} >= {_letter(o)}' for o in 'anot' if o != c)} then '{c}'" for c in "anot") + " else '' end"


def mix_documents(docs: DataFrame) -> DataFrame:
    """mix() with production parameters; tokens are taken as a quarter of the UTF-8 bytes."""
    tokens = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)
    return mix(docs, tokens, F.col("source"), F.col("lang"), F.expr(TOPIC))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    mixed = mix_documents(docs)
    digits = [F.round(c, 9).alias(c) for c in ("weight", "probability")]
    return mixed.select(*unpack(mixed, docs.columns), "topic", "tokens", *digits, "sampled").drop("text")


OP1_SQL = f"""
with recursive d as (
  select doc_id, source, lang, coalesce(source, '') as s, coalesce(lang, '') as l, {TOPIC} as topic,
         greatest(1, (strlen(coalesce(text, '')) + 3) // 4)::bigint as tokens from documents),
cells as (select s, l, topic, sum(tokens)::double as mass from d group by all),
ts as (select s, p / sum(p) over () as ts from (select s, pow(sum(mass) / (select sum(mass) from cells), {TEMPER}) as p from cells group by s)),
tl as (select l, p / sum(p) over () as tl from (select l, pow(sum(mass) / (select sum(mass) from cells), {TEMPER}) as p from cells group by l)),
tt as (select topic, p / sum(p) over () as tt from (select topic, pow(sum(mass) / (select sum(mass) from cells), {TEMPER}) as p from cells group by topic)),
ipf(k, s, l, topic, mass, w, ts, tl, tt, total) as (
  select 0, s, l, topic, mass, mass, ts, tl, tt, sum(mass) over () from cells join ts using (s) join tl using (l) join tt using (topic)
  union all
  select k + 1, s, l, topic, mass,
         case k % 3 when 0 then w * ts * total / sum(w) over (partition by s)
                    when 1 then w * tl * total / sum(w) over (partition by l)
                    else w * tt * total / sum(w) over (partition by topic) end, ts, tl, tt, total
  from ipf where k < {3 * SWEEPS}),
f as (select s, l, topic, mass, w / mass as weight, total from ipf where k = {3 * SWEEPS}),
o as (select *, coalesce(sum(mass) over o, 0) as before, sum(mass * weight) over () - coalesce(sum(mass * weight) over o, 0) as rest from f
      window o as (order by weight desc, s, l, topic rows between unbounded preceding and 1 preceding)),
c as (select max_by(({BUDGET} * total - before) / rest, weight) as scale from o where ({BUDGET} * total - before) / rest * weight <= 1)
select doc_id, source, lang, topic, tokens, round(weight, 9) as weight, round(least(1, scale * weight), 9) as probability,
       ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / {float(1 << 52)} < least(1, scale * weight) as sampled
from d join f using (s, l, topic), c
"""
