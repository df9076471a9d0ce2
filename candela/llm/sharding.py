"""Sharding by a permutation-filled lookup table (DataFrame functions only on the data path).

Each shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. Shards take
turns; each claims its next unclaimed slot. The table depends on the shard names and its size alone, never on the data,
so it is filled once on the driver and broadcast: `table_size` rows, bounded by MOST_SLOTS.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SLOTS = 1 << 20
#: 100 slots or more a shard keep the shares of shards within about 1 % of each other.
SHARDS, SLOTS = tuple(f"shard-{i:02d}" for i in range(16)), 2039


def _hash(salt: str, name: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: tuple[str, ...], size: int) -> list[int]:
    """For each slot the index of its shard. size: a prime from the number of shards up to MOST_SLOTS."""
    if not 1 <= len(shards) <= size <= MOST_SLOTS or len(set(shards)) < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct, and size a prime from their number to MOST_SLOTS")
    at = [_hash("offset", s) % size for s in shards]
    step = [_hash("skip", s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup_table(spark: SparkSession, shards: tuple[str, ...], size: int) -> DataFrame:
    """Rows (slot, shard): size of them."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.array(*map(F.lit, shards))
    table = spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "owner"))
    return table.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def key_slot(key: Column, size: int) -> Column:
    """Slot of a key: the first 15 hex digits of the MD5 of its text (null: of the empty text) modulo size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size


def assign_shards(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, size: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (columns of these names are replaced). No shuffle; rows of equal keys share a shard.

    A hot key makes one shard large; give a finer key (a document's id rather than its source) to split it.
    """
    table = F.broadcast(lookup_table(df.sparkSession, shards, size))
    keyed = df.withColumn("slot", key_slot(key, size)).drop("shard")
    return keyed.join(table, "slot", "left").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return assign_shards(docs, F.col("doc_id"))


_NAMES = ", ".join(f"'{s}'" for s in SHARDS)
OP5_SQL = f"""
with recursive s as (
  select list(('0x' || substr(md5('offset:' || n), 1, 15))::bigint % {SLOTS} order by n) as off,
         list(('0x' || substr(md5('skip:' || n), 1, 15))::bigint % {SLOTS - 1} + 1 order by n) as skip
  from (select unnest([{_NAMES}]) as n)),
-- one row per look at a slot: shard i looks at its next slot, claims it if it is free (then the turn passes), else goes on
turn(k, i, slot, claims, taken, pos, skip) as (
  select 0::bigint, 0, off[1], false, bitstring('0', {SLOTS}), off, skip from s
  union all
  select k + 1,
         case when free then (i + 1) % {len(SHARDS)} else i end,
         p, free, case when free then set_bit(taken, p::int, 1) else taken end,
         list_transform(pos, lambda x, j: case when j = i + 1 then (x + skip[j]) % {SLOTS} else x end), skip
  from (select *, pos[i + 1] as p, get_bit(taken, pos[i + 1]::int) = 0 as free from turn where bit_count(taken) < {SLOTS})),
owner as (select t.slot, [{_NAMES}][u.i + 1] as shard from turn t join turn u on u.k = t.k - 1 where t.claims),
d as (select doc_id, source, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {SLOTS} as slot from documents)
select d.doc_id, d.source, d.slot, o.shard from d left join owner o using (slot)
"""
