"""Shard placement by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table; in turns every shard
claims its next free slot until the table is full. A key's slot is its hash modulo the table size.
Shards own equal shares up to one slot, and when a shard joins or leaves few other keys move. The
table has a fixed size whatever the data, so it's broadcast and placement costs one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

#: The prime number of slots; a hundred or more for each shard keeps shares within one per cent.
TABLE_SIZE = 65_537
_HEX = 15


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:_HEX], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the position in `shards` of its owner.

    Shards are named; the order in which they take turns is the order of their names, so the table
    doesn't depend on the order of the list.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime of at least the number of shards")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for i in turn:
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot] = i
            at[i] = (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: F.Column, size: int = TABLE_SIZE) -> F.Column:
    """Slot of a key: the first 60 bits of the MD5 of its text form, modulo the table size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, _HEX), 16, 10).cast("bigint") % F.lit(size)


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, slot, shard) for every row of docs.

    A NULL key is placed as the empty text would be, so that it has one defined shard. Repeated rows
    get the same shard and stay. An empty table gives none. Columns other than the key are ignored.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(shards[i] for i in fill_table(shards, size))), "__slot bigint, shard string")
    keyed = docs.select(docs[f"`{key}`"].alias(key)).withColumn("slot", slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), size))
    # `size` rows, fixed by a parameter and not by the data
    return keyed.join(F.broadcast(table), keyed["slot"] == table["__slot"]).select(key, "slot", "shard")


def place_sql(shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> str:
    """The same over a table `documents` in SQL, with the table filled by plain turn-taking: every shard
    walks its whole preference list. The owners stand in one string of fixed-width numbers."""
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    steps = [(_hash(shards[i], "offset") % size, _hash(shards[i], "skip") % (size - 1) + 1) for i in order]
    walks = [iter([(offset + j * skip) % size for j in range(size)]) for offset, skip in steps]
    owner: dict[int, int] = {}
    while len(owner) < size:
        for i, walk in zip(order, walks, strict=True):
            slot = next((s for s in walk if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    width = len(str(len(shards) - 1))
    table = "".join(f"{owner[s]:0{width}d}" for s in range(size))
    names = ", ".join("'" + s.replace("'", "''") + "'" for s in shards)
    return (
        f"WITH d AS (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, {_HEX}))::BIGINT % {size} AS slot FROM documents) "
        f"SELECT {key}, slot, [{names}][substr('{table}', (slot * {width} + 1)::BIGINT, {width})::INT + 1] AS shard FROM d"
    )
