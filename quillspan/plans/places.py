"""Gapless positions inside groups, without a window that puts a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.plans.scratch import Scratch

PLACE_BITS = 33  # monotonically_increasing_id keeps the place in the partition in these low bits


def placed(df: DataFrame, groups: list[str], order: list[Column], scratch: Scratch, name: str = "position") -> DataFrame:
    """df with the row's place (from 0) in its group under order, which must be total within a group; without groups, in the whole of df.

    One range exchange sorts all rows, and the sorted rows are written. A row's place in its partition, plus the group's rows in earlier partitions,
    is its position: these counts are a row for each partition that a group reaches into. Groups may be of any size; null is a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in groups]
    sorted_ = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.write(sorted_, "sorted").withColumn("_part", F.shiftright("_at", PLACE_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1))
    runs = sorted_.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = scratch.write(runs.withColumn("_before", F.coalesce(before, F.lit(0))), "runs").drop("_rows")
    same, renamed = F.col("_part") == F.col("_p"), [F.col("_part").alias("_p"), "_first", "_before"]
    for i, c in enumerate(groups):
        renamed.append(F.col(c).alias(f"_g{i}"))
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return sorted_.join(runs.select(*renamed), same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
