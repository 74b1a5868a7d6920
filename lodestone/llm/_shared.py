"""Plumbing that the training-data operators share: scratch tables and row keys."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a folder
    of its own. On a cluster a missing setting is an error, as a folder of
    one machine would not be seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"/tmp/checkpoints/lodestone-{os.getpid()}"
    os.makedirs(root, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at exit at the latest."""
    path = f"{scratch_root(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: after it a lost executor costs a reread, not a rerun,
    and values that depend on task numbering stay as they were written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the scratch tables written so far and not deleted."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; no frame over them may still be in use."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), paths)


def _delete(jvm, hadoop, paths: list[str]) -> None:
    for name in list(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
        _written.remove(name)


@atexit.register
def _forget() -> None:
    """At exit no frame is in use any more: delete what is left, on shared storage too."""
    gateway = SparkContext._gateway
    if _written and gateway is not None:
        try:
            _delete(gateway.jvm, gateway.jvm.org.apache.hadoop.conf.Configuration(), _written)
        except (Py4JError, OSError):  # the JVM has gone already
            pass
    for path in _written:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    shutil.rmtree(f"/tmp/checkpoints/lodestone-{os.getpid()}", ignore_errors=True)


#: Keys with more than this share of the rows are joined by broadcast; there are at most so many.
HOT_KEYS = 2048


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Inner join of ``rows`` to ``values``, which has one row a key and in ``count`` how many of the rows have it.

    ``values`` must be a written table, and keys must not be null. A key that
    holds more than 1 / HOT_KEYS of the rows would make a task of its own in
    a shuffle join. There are fewer than HOT_KEYS of those, as their counts
    add up to the rows, so their values are broadcast; rows that have them
    are then spread over all tasks of the shuffle that the others need. The
    column ``count`` is dropped.
    """
    most = values.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    limit = max(1, (most["total"] or 0) // HOT_KEYS)
    others = [c for c in values.columns if c not in (*keys, count)]
    if (most["most"] or 0) <= limit:
        return rows.join(values.drop(count), keys)

    def side(name: str, kept: DataFrame) -> DataFrame:
        return kept.select(*[F.col(k).alias(f"{name}{k}") for k in keys], F.struct(*others, F.lit(1).alias(name)).alias(name))

    def same(name: str):
        out = F.lit(True)
        for k in keys:
            out = out & (F.col(k) == F.col(f"{name}{k}"))
        return out

    hot, cold = side("_hot", values.where(F.col(count) > limit)), side("_cold", values.where(F.col(count) <= limit))
    met = rows.join(F.broadcast(hot), same("_hot"), "left")
    spread = F.when(F.col("_hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_KEYS)) + 1).otherwise(F.lit(0).cast("long"))
    both = met.withColumn("_spread", spread).join(cold.withColumn("_zero", F.lit(0).cast("long")), same("_cold") & (F.col("_spread") == F.col("_zero")), "left")
    found = both.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull())
    mine = [F.col(c) for c in rows.columns if c not in keys]
    return found.select(*keys, *mine, *[F.when(F.col("_hot").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in others])


#: Rows of one range of a running sum; more rows make more ranges.
RANGE_ROWS = 1 << 20


def _sums_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, last, carry = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        values = batch.column("_value").to_numpy()
        first = np.append(keys[0] != last, keys[1:] != keys[:-1]).astype(bool)
        before = np.cumsum(values) - values
        start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        before = before - np.where(start >= 0, before[start], -carry)
        last, carry = keys[-1], int(before[-1] + values[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(before)], [*batch.schema.names, "_part", "_before"])


def running_sum(rows: DataFrame, key: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum, in ``name``, of ``value`` over the rows before each one that have its ``key``.

    Rows stand by ``order``, nulls first; those that tie in it must be alike
    in ``value``. ``rows`` must be a written table, ``key`` not null and
    ``value`` a long of at least 0. A key may hold any share of the rows:
    rows are dealt by ranges of key, order and place, summed within a range,
    and a range whose first key began in an earlier one gets what that key
    had there. This is one row a range at most, so it goes through the driver.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", key).withColumn("_value", value).withColumn("_tie", F.monotonically_increasing_id())
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    by = ["_key", *order, "_tie"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", _part int, _before long"
    summed = materialize(keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(_sums_within, schema), "sums")
    ends = summed.groupBy("_part").agg(F.min("_key").alias("first"), F.max(F.struct("_key", (F.col("_before") + F.col("_value")).alias("upto"))).alias("last"))
    carried, open_key, had = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        if r["first"] == open_key:
            carried.append((r["_part"], open_key, had))
        had = r["last"]["upto"] + (had if r["last"]["_key"] == open_key else 0)
        open_key = r["last"]["_key"]
    earlier = spark.createDataFrame(carried, f"_part int, _key {summed.schema['_key'].dataType.simpleString()}, _had long")
    whole = summed.join(F.broadcast(earlier), ["_part", "_key"], "left")
    return whole.select(*rows.columns, (F.col("_before") + F.coalesce("_had", F.lit(0))).alias(name))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns, named ``_k1`` and ``_k2``: a key that is never null.

    Rows that agree in all of the columns share it; they are one document.
    """
    cells = [F.col(c) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return [
        F.xxhash64(*cells, *nulls).alias("_k1"),
        F.xxhash64(F.lit("second"), *reversed(cells), *nulls).alias("_k2"),
    ]


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
