"""Joins and sums that survive one key holding a third of all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut, parallelism

#: At least so many keys are set apart as heavy, and as many as there are shuffle partitions.
HEAVY_KEYS = 32


def most_heavy(spark: SparkSession, least: int = HEAVY_KEYS) -> int:
    """How many keys to set apart so that each other one holds less than one partition's share of the rows."""
    return max(least, parallelism(spark))


def heavy_keys(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """The `most` keys with the most rows in df, nulls left out; columns (key).

    By default there are as many as shuffle partitions: no other key holds as
    much as one partition's share, whatever the size of the cluster. Never
    more than `most` rows, so it may be broadcast whatever the input. Rows are
    counted before the shuffle. Ties fall by key, so that two evaluations
    agree. Empty input gives no rows.
    """
    most = most_heavy(df.sparkSession) if most is None else most
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.asc(key)).limit(most).select(key)


#: A heavy key's rows are spread over so many join partitions.
SALTS = 16


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", most: int | None = None) -> DataFrame:
    """Equi-join on `key` where right has one row per key and left may be skewed.

    Left rows of heavy keys are spread by a hash of the row, and the few right
    rows of those keys (at most `most`) are repeated once per salt; all other
    keys join as ever. how is left or inner. Null keys match nothing, are kept
    by a left join and spread likewise. The result's columns are the key, the
    rest of left, the rest of right.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    # Bounded by `most` rows, so broadcast is safe at any size.
    heavy = F.broadcast(heavy_keys(left, key, most).withColumn("_heavy", F.lit(True)))
    slot = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    salt = F.when(F.col("_heavy") | F.col(key).isNull(), slot).otherwise(0)
    salted = left.join(heavy, key, "left").withColumn("_salt", salt).drop("_heavy")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(heavy, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def global_index(df: DataFrame, order: list[str], value: Column | None = None, index: str = "_index") -> DataFrame:
    """Exclusive running sum of `value` (1 if none) over the rows sorted by `order`.

    Range partitioning spreads even a single hot prefix by the later order
    columns; only one number per partition goes to the driver. The sorted rows
    are written to the checkpoint folder so that both passes see the same
    partitions. `order` should identify a row; ties fall in any order.
    """
    rows = df.withColumn("_v", (value if value is not None else F.lit(1)).cast("long"))
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = rows.withColumn("_part", F.spark_partition_id())
    sums = {r["_part"]: r["_s"] for r in rows.groupBy("_part").agg(F.sum("_v").alias("_s")).collect()}
    starts, at = {}, 0
    for p in sorted(sums):
        starts[p], at = at, at + (sums[p] or 0)

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                total = starts[batch.column("_part")[0].as_py()]
            values = batch.column("_v").fill_null(0).to_numpy(zero_copy_only=False)
            before = np.cumsum(values) - values + total
            total += int(values.sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(before, pa.int64())], [*keep, index])

    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(index, T.LongType())])
    return rows.mapInArrow(run, schema)


#: A table of at most so many narrow rows may be sent to every executor.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, cut and counted, marked for broadcast if it has at most `most` rows; a larger one joins by shuffle.

    For narrow tables whose size isn't known before they are made: the other
    side of the join then keeps its partitioning.
    """
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """skew_join, but by broadcast where right is known to be small.

    rows: a bound on right's rows the caller has counted; without one right is
    written and counted. Up to BROADCAST_ROWS of them go to every executor, so
    that left, hot keys and all, stays where it is.
    """
    if rows is None:
        right = cut(right)
        rows = right.count()
    return left.join(F.broadcast(right), key, how) if rows <= BROADCAST_ROWS else skew_join(left, right, key, how)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A small file is one partition, which would leave costly Python work to one
    core. Large inputs have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
