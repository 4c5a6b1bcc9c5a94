"""Sharding by a permutation-filled lookup table (Eisenbud et al., "Maglev", 2016).

Every shard has a preference order of all slots of a table of prime size: from an offset in steps of a skip, both hashed from its
name. Shards take turns, and in its turn a shard claims the first slot of its order that is free. A key belongs to the shard of its
hash's slot: constant time, shares that differ by a slot at most, and few keys that move when a shard comes or goes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(name: str, what: str) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, turns: list[int] | None = None) -> list[int]:
    """The shard's number for each slot. `turns`: how many slots each shard claims in a round, for shards of unequal size.

    `slots` must be prime and not below the number of shards; names must differ, as equal names have equal orders.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each by its own name")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, not below that of shards")
    turns = turns or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("turns must be a number for each shard, not all 0")
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    at = [_number(s, "offset") % slots for s in shards]
    table, claimed = [-1] * slots, 0
    while True:
        for k, times in enumerate(turns):
            for _ in range(times):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                claimed += 1
                if claimed == slots:
                    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of the MD5 of its text; a null key's is that of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, turns: list[int] | None = None) -> DataFrame:
    """(key_col, slot, shard: its number, shard_name) of each row.

    The table is broadcast: `slots` rows, whatever there is to place. Rows with equal keys go to one shard; null keys all go to that
    of the empty text. Other columns are ignored, so that none can clash. An empty table gives an empty table.
    """
    table = [(k, s, shards[s]) for k, s in enumerate(lookup_table(shards, slots, turns))]
    lookup = rows.sparkSession.createDataFrame(table, "slot long, shard int, shard_name string")
    return rows.select(F.col(key_col), slot(F.col(key_col), slots).alias("slot")).join(F.broadcast(lookup), "slot").select(key_col, "slot", "shard", "shard_name")
