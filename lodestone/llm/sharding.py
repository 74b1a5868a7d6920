"""Consistent sharding through a lookup table that the shards fill by turns."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 65537) -> np.ndarray:
    """The shard number of every slot of a table of prime ``size``.

    Each shard prefers the slots in the order of a permutation of its own,
    offset + k * skip modulo the prime. The shards take turns, and at a turn
    a shard claims its most preferred slot that is still free. Shares differ
    by one slot at most, and a shard that leaves or joins moves few others.
    """
    if not is_prime(size):
        raise ValueError(f"the table's size must be prime, not {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, one at least and at most one a slot")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table = [-1] * size
    filled = 0
    while filled < size:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % size
            table[slot] = shard
            at[shard] = (slot + skip[shard]) % size
            filled += 1
            if filled == size:
                break
    return np.array(table, np.int32)


def slot_of(size: int, *key: str) -> Column:
    """Slot of a row by its key columns; nulls hash like any value."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in key], *[F.col(k).isNull() for k in key]), F.lit(size)).cast("int")


def place(rows: DataFrame, shards: list[str], key: tuple[str, ...] = ("doc_id",), size: int = 65537) -> DataFrame:
    """Put every row on a shard: ``rows`` with the columns slot, shard and shard_name.

    One hash and one look into a table of ``size`` entries, which is what is
    broadcast, however many rows or shards there are. Nothing is shuffled.
    Rows with equal keys share a shard; null keys are one key. Columns named
    slot, shard or shard_name are replaced. An empty table stays empty.
    """
    table = lookup_table(shards, size)
    entries = [(slot, int(shard), shards[shard]) for slot, shard in enumerate(table.tolist())]
    slots = rows.sparkSession.createDataFrame(entries, "_slot int, shard int, shard_name string")
    kept = rows.drop("slot", "shard", "shard_name", "_slot")
    return kept.withColumn("slot", slot_of(size, *key)).join(F.broadcast(slots), F.col("slot") == F.col("_slot")).drop("_slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int | None = None, file_bytes: int = 128 << 20) -> None:
    """Write placed rows as one folder a shard, of ``files_per_shard`` files or of files of about ``file_bytes`` of text.

    Rows of a shard are dealt over its files by their place in the input, so
    a shard with one very frequent key or row is written by all of its tasks.
    ``placed`` must come from a scan or a written table, so that a task run
    anew deals alike. Bytes are counted in its string columns, nulls as none.
    An empty table writes no shard. Columns are written as they are.
    """
    strings = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in placed.schema if f.dataType.simpleString() == "string"]
    weight = sum(strings, F.lit(64).cast("long"))
    files = F.lit(files_per_shard) if files_per_shard else F.ceil(F.sum(weight) / file_bytes)
    # one row a shard, and there are at most as many shards as slots
    sizes = placed.sparkSession.createDataFrame(placed.groupBy("shard").agg(files.cast("long").alias("_files")).collect(), "shard int, _files long")
    total = sizes.agg(F.sum("_files")).first()[0] or 1
    planned = placed.join(F.broadcast(sizes), "shard").withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
    planned.repartition(int(total), "shard", "_file").drop("_files", "_file").write.partitionBy("shard").parquet(path)
