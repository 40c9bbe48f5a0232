"""Sharding by a permutation-filled lookup table, with native expressions only.

Shards take turns claiming the next free slot in their own order of preference, a permutation of the slots of a
prime-sized table made from two hashes of the shard's name. Every shard so owns the same number of slots give or take
one, and removing a shard moves few keys besides its own. The table has a fixed size, so it is broadcast whatever the
data's, and a row's shard is one lookup by the slot of its key's hash.

Defined results: a null key goes to the slot of the empty string; equal keys go to one shard; an empty table gives
an empty result; other columns are kept by assign(), but for ``slot`` and ``shard``, which it replaces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: A prime: the table's size, and with it the bound of what is broadcast.
SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _hash(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if not 0 < len(shards) <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is at least the number of shards")
    offset = [_hash(f"{s}/offset") % slots for s in shards]
    skip = [_hash(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    owner: list[str | None] = [None] * slots
    turn = [0] * len(shards)
    for claim in range(slots):
        i = claim % len(shards)
        while owner[at := (offset[i] + turn[i] * skip[i]) % slots] is not None:
            turn[i] += 1
        owner[at] = shards[i]
        turn[i] += 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with ``slot`` and ``shard``."""
    df = df.drop(*({"slot", "shard"} - {key}))
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, shard string")
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*[c for c in df.columns if c != "slot"], "slot", "shard")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir).select("doc_id"), "doc_id")


#: The same table by a recursive query: one row a claim, with the owners so far and each shard's next preference.
SQL = f"""
with recursive shards as (
  select i, printf('shard-%02d', i) as shard,
         ('0x' || substr(sha256(printf('shard-%02d/offset', i)), 1, 15))::bigint % {SLOTS} as off,
         ('0x' || substr(sha256(printf('shard-%02d/skip', i)), 1, 15))::bigint % {SLOTS - 1} + 1 as skip
  from range({len(SHARDS)}) t(i)),
prefs as (select list(off order by i) as offs, list(skip order by i) as skips from shards),
claims as (
  select 0 as n, -1::bigint as slot, -1::bigint as i, list_transform(range({SLOTS}), lambda x: false) as used, list_transform(range({len(SHARDS)}), lambda x: 0::bigint) as turn
  union all
  select n + 1, slot, i, list_transform(used, lambda u, x: u or x - 1 = slot), list_transform(turn, lambda t, x: case when x - 1 = i then j + 1 else t end)
  from (select n, i, j, used, turn, (offs[i + 1] + j * skips[i + 1]) % {SLOTS} as slot
        from (select n, used, turn, offs, skips, n % {len(SHARDS)} as i,
                     list_filter(range(turn[n % {len(SHARDS)} + 1], {SLOTS}), lambda j: not used[(offs[n % {len(SHARDS)} + 1] + j * skips[n % {len(SHARDS)} + 1]) % {SLOTS} + 1])[1] as j
              from claims, prefs where n < {SLOTS})))
select d.doc_id, c.slot::int as slot, s.shard
from (select doc_id, ('0x' || substr(sha256(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {SLOTS} as slot from documents) d
join claims c on c.slot = d.slot join shards s on s.i = c.i
"""
