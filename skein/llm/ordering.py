"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.runtime import stage

_ROW = (1 << 33) - 1


def ranked(df: DataFrame, order: list[Column], name: str = "rank", distinct: list[str] | None = None) -> DataFrame:
    """df with a 0-based global rank: range-partitioned sort, then the partitions' offsets (one number each).

    distinct: the columns that order sorts by, if rows equal in them are to be one; they meet in one partition anyhow.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order)
    placed = placed.dropDuplicates(distinct) if distinct else placed
    placed = placed.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed, "ranked")
    sizes = placed.groupBy(F.shiftrightunsigned("_at", 33).alias("p")).count().collect()  # one row a partition
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r["p"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_p long, _before long")
    out = placed.join(F.broadcast(offsets), F.shiftrightunsigned("_at", 33) == F.col("_p"))
    return out.withColumn(name, F.col("_at").bitwiseAND(F.lit(_ROW)) + F.col("_before")).drop("_at", "_p", "_before")


def running_start(df: DataFrame, key: str, bucket: str, order: list, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its key that come before it by (bucket, order).

    Windows hold one bucket of a key, or one number a bucket: a key with a third of all rows is no single task.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_s"))
    before = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(key, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(offsets, [key, bucket]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from df's columns, which may have any names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
